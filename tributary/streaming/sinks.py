"""Stream writers: Parquet, topic, documents; and the trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tributary.config import Config
from tributary.registry import Context, Property, Writer, component
from tributary.sources import checkpoint, topic

COMMON = {"writer.common.checkpoint.location": Property("Checkpoint location"), "writer.common.trigger.type": Property("Trigger", "Once, AvailableNow or ProcessingTime", False),
          "writer.common.trigger.processing.time": Property("Interval", "milliseconds", False)}


def trigger(conf: Config) -> dict:
    """Arguments of ``DataStreamWriter.trigger``; ``Once`` (the default) makes exactly one micro-batch."""
    kind = conf.get("writer.common.trigger.type", "Once").strip().lower()
    if kind == "once":
        return {"once": True}
    if kind == "availablenow":
        return {"availableNow": True}
    if kind == "processingtime":
        ms = conf.number("writer.common.trigger.processing.time", 0)
        if ms < 0:
            raise ValueError("the trigger interval can't be negative")
        return {"processingTime": f"{ms} milliseconds"}
    raise ValueError(f"'writer.common.trigger.type' can't be {kind!r}")


def begin(df: DataFrame, when: dict, location: str, options: dict[str, str]) -> DataStreamWriter:
    return df.writeStream.trigger(**when).outputMode("append").options(**options).option("checkpointLocation", location)


@component("parquet-writer")
class ParquetWriter(Writer):
    name = "Parquet stream writer"
    description = "Appends to a Parquet folder, partitioned if asked for; optionally refuses a folder with uncommitted files."
    properties = {"writer.parquet.destination.directory": Property("Destination"), "writer.parquet.partition.columns": Property("Partition columns", "", False),
                  "writer.parquet.metadata.check": Property("Consistency check", "true or false", False), **COMMON}
    extra_prefix = "writer.parquet.options"

    def __init__(self, destination: str, when: dict, location: str, partition_by: list[str] | None = None, check: bool = False, options: dict[str, str] | None = None):
        if not destination.strip():
            raise ValueError("the destination must not be blank")
        self.destination, self.when, self.location, self.partition_by, self.check_files, self.options = destination, when, location, partition_by or [], check, options or {}

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> ParquetWriter:
        return cls(conf.require("writer.parquet.destination.directory"), trigger(conf), conf.require("writer.common.checkpoint.location"),
                   conf.list("writer.parquet.partition.columns", []), conf.boolean("writer.parquet.metadata.check"), dict(conf.subset(cls.extra_prefix)))

    def write(self, df: DataFrame) -> StreamingQuery:
        if self.check_files and (odd := checkpoint.uncommitted_files(df.sparkSession, self.destination)):
            raise RuntimeError(f"{len(odd)} files are not in the sink's log: {', '.join(sorted(odd)[:20])}")
        w = begin(df, self.when, self.location, self.options).format("parquet")
        return (w.partitionBy(*self.partition_by) if self.partition_by else w).start(self.destination)


@component("kafka-writer")
class KafkaWriter(Writer):
    name = "Kafka stream writer"
    description = "Writes key and value to a topic, at least once."
    properties = {"writer.kafka.topic": Property("Topic"), "writer.kafka.brokers": Property("Brokers", "comma-separated"), **COMMON}
    extra_prefix = "writer.kafka.option"

    def __init__(self, topic_: str, brokers: str, location: str, when: dict, options: dict[str, str] | None = None):
        if not topic_.strip() or not brokers.strip():
            raise ValueError("topic and brokers must not be blank")
        self.topic, self.brokers, self.location, self.when, self.options = topic_, brokers, location, when, options or {}

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> KafkaWriter:
        return cls(conf.require("writer.kafka.topic"), ",".join(conf.list("writer.kafka.brokers")), conf.require("writer.common.checkpoint.location"), trigger(conf), dict(conf.subset(cls.extra_prefix)))

    def write(self, df: DataFrame) -> StreamingQuery:
        return topic.source(df.sparkSession, begin(df, self.when, self.location, self.options), self.brokers).option("topic", self.topic).start()


@component("document-writer")
class DocumentWriter(Writer):
    name = "Document stream writer"
    description = "Appends each micro-batch as documents: to MongoDB (mongodb://), or to a folder of JSON lines (file:)."
    properties = {"writer.mongodb.uri": Property("URI"), "writer.mongodb.database": Property("Database", "", False), "writer.mongodb.collection": Property("Collection", "", False), **COMMON}
    extra_prefix = "writer.mongodb.options"

    def __init__(self, when: dict, location: str, uri: str, database: str | None = None, collection: str | None = None, options: dict[str, str] | None = None):
        if not uri.startswith(("mongodb://", "file:")):
            raise ValueError("the URI must begin with mongodb:// (or file: for a folder)")
        self.when, self.location, self.uri, self.database, self.collection, self.options = when, location, uri, database, collection, options or {}

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> DocumentWriter:
        return cls(trigger(conf), conf.require("writer.common.checkpoint.location"), conf.require("writer.mongodb.uri"), conf.get("writer.mongodb.database"), conf.get("writer.mongodb.collection"),
                   {**conf.subset("writer.mongodb.option"), **conf.subset(cls.extra_prefix)})

    def save(self, batch: DataFrame, batch_id: int) -> None:
        where = {k: v for k, v in (("database", self.database), ("collection", self.collection)) if v}
        if self.uri.startswith("mongodb://"):
            batch.write.format("mongodb").mode("append").option("connection.uri", self.uri).options(**where, **self.options).save()
        else:
            # A folder for each batch: a repeated batch replaces itself.
            batch.write.mode("overwrite").options(**self.options).json("/".join([self.uri, *where.values(), f"batch={batch_id}"]))

    def write(self, df: DataFrame) -> StreamingQuery:
        return df.writeStream.trigger(**self.when).option("checkpointLocation", self.location).foreachBatch(self.save).start()
