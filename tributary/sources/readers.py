"""Stream readers."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession

from tributary import fs
from tributary.config import Config
from tributary.registry import Context, Property, Reader, component
from tributary.sources import checkpoint
from tributary.sources import topic as topics

log = logging.getLogger(__name__)


def alive(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        raise RuntimeError("the Spark session has stopped")


@component("kafka-reader")
class KafkaReader(Reader):
    name = "Kafka stream reader"
    description = "Subscribes to one topic; begins at the earliest record while there is no checkpoint yet."
    properties = {"reader.kafka.topic": Property("Topic"), "reader.kafka.brokers": Property("Brokers", "comma-separated"),
                  "writer.common.checkpoint.location": Property("Checkpoint location")}
    extra_prefix = "reader.option"

    def __init__(self, topic: str, brokers: str, checkpoint: str, options: dict[str, str] | None = None):
        if not topic.strip() or not brokers.strip():
            raise ValueError("topic and brokers must not be blank")
        self.topic, self.brokers, self.checkpoint, self.options = topic, brokers, checkpoint, options or {}

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> KafkaReader:
        brokers, options = ",".join(conf.list("reader.kafka.brokers")), dict(conf.subset(cls.extra_prefix))
        if brokers.startswith("file:") and conf.get("writer.common.trigger.type", "Once").strip().lower() != "processingtime":
            # As Kafka's source does: one batch takes all there is. (Kafka splits it under AvailableNow, the topic log doesn't.)
            options = {k: v for k, v in options.items() if k.lower() != "maxoffsetspertrigger"}
        return cls(conf.require("reader.kafka.topic"), brokers, conf.require("writer.common.checkpoint.location"), options)

    def read(self, spark: SparkSession) -> DataFrame:
        alive(spark)
        log.info("reading %s with %s", self.topic, Config(self.options).redacted())
        r = topics.source(spark, spark.readStream, self.brokers).option("subscribe", self.topic)
        if fs.is_empty(spark, self.checkpoint):
            r = r.option("startingOffsets", "earliest")
        elif self.brokers.startswith("file:") and (done := checkpoint.latest_committed_offsets(spark, self.checkpoint)):
            r = r.option("committedOffsets", json.dumps(done[1].get(self.topic, done[1])))
        return r.options(**self.options).load()


@component("parquet-reader")
class ParquetReader(Reader):
    name = "Parquet stream reader"
    description = "Infers the schema once by a batch read (so the folder can't be empty), then streams the folder."
    properties = {"reader.parquet.source.directory": Property("Source directory")}
    extra_prefix = "reader.parquet.options"

    def __init__(self, path: str, options: dict[str, str] | None = None):
        if not path.strip():
            raise ValueError("the source directory must not be blank")
        self.path, self.options = path, options or {}

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> ParquetReader:
        return cls(conf.require("reader.parquet.source.directory"), dict(conf.subset(cls.extra_prefix)))

    def read(self, spark: SparkSession) -> DataFrame:
        alive(spark)
        schema = spark.read.options(**self.options).parquet(self.path).schema
        return spark.readStream.schema(schema).options(**self.options).parquet(self.path)
