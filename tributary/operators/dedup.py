"""De-duplication of a topic sink after a failed batch.

If the checkpoint's last planned batch was not committed, some of its records may be in the sink already. Their ids are
the source's ids from the last committed to the planned offsets that also are among at least as many latest ids of every
sink partition. They are found once, when the plan is built, by batch reads and a semi-join, written to the table folder
beside the checkpoint, and taken out of the stream by a left anti-join. One source and one sink topic, one writer, and
nothing written since the failure are required.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary import fs
from tributary.config import Config
from tributary.operators import avro
from tributary.operators.cdc import quoted
from tributary.registry import Context, Property, Transformer, component
from tributary.sources import checkpoint, topic

META = ("topic", "partition", "offset", "timestamp", "timestampType")


def field(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``__id`` from a record field: metadata, serialized sizes, ``key.<path>`` or ``value.<path>``."""
    if name in META:
        return df.withColumn("__id", F.col(name))
    if name in ("serializedKeySize", "serializedValueSize"):
        return df.withColumn("__id", F.coalesce(F.length("key" if "Key" in name else "value"), F.lit(-1)))
    head, _, path = name.partition(".")
    if head not in ("key", "value") or not path:
        raise ValueError(f"'{name}' is no record field")
    at = F.col(f"__{head}")
    for part in path.split("."):
        at = at[part]
    return df.withColumn("__id", at)


def ids_of(df: DataFrame, names: list[str], schemas: dict[str, object], registry) -> DataFrame:
    """Columns ``id0, id1, …``; a null id is an error."""
    for side in ("key", "value"):
        if any(n.startswith(side + ".") for n in names):
            df = avro.decode_column(df, side, schemas[side], registry, f"__{side}")
    for i, n in enumerate(names):
        df = field(df, n).withColumnRenamed("__id", f"id{i}")
        df = df.withColumn(f"id{i}", F.coalesce(f"id{i}", F.raise_error(F.lit(f"record field {n} is null")).cast(dict(df.dtypes)[f"id{i}"])))
    return df.select(*(f"id{i}" for i in range(len(names))))


def offsets_by_partition(offsets: dict, name: str) -> dict[int, int]:
    return {int(p): int(o) for p, o in offsets.get(name, offsets).items()}


@component("topic-deduplicator")
class TopicDeduplicator(Transformer):
    name = "Topic de-duplicator"
    description = "After a failed batch, drops the records that already are in the sink topic."
    properties = {"source.id.columns": Property("Source ids"), "destination.id.columns": Property("Destination ids"), "kafka.consumer.timeout": Property("Timeout", "seconds, default 120", False)}
    retained = {"reader.kafka": "reader", "writer.kafka": "writer", "writer.common.checkpoint.location": "checkpoint", "schema.registry": "registry"}

    def __init__(self, reader: tuple[str, str], writer: tuple[str, str], location: str, source_ids: list[str], sink_ids: list[str], registry=None,
                 schema_of: Callable[[str, bool], object] | None = None, timeout_s: int = 120):
        if not source_ids or len(source_ids) != len(sink_ids):
            raise ValueError("as many source as destination ids are needed")
        self.reader, self.writer, self.location, self.source_ids, self.sink_ids = reader, writer, location, source_ids, sink_ids
        self.registry, self.schema_of, self.timeout_s = registry, schema_of, timeout_s

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> TopicDeduplicator:
        from tributary.functions import schema_registry

        r = schema_registry.client(Config({f"schema.registry.{k}": v for k, v in conf.subset("registry").items()}))
        return cls((conf.require("reader.topic"), ",".join(conf.list("reader.brokers"))), (conf.require("writer.topic"), ",".join(conf.list("writer.brokers"))), conf.require("checkpoint"),
                   conf.list("source.id.columns"), conf.list("destination.id.columns"), r, lambda t, key: r.latest(f"{t}-{'key' if key else 'value'}")[1], conf.number("kafka.consumer.timeout", 120))

    def _schemas(self, topic_: str, names: list[str]) -> dict[str, object]:
        return {s: self.schema_of(topic_, s == "key") for s in ("key", "value") if any(n.startswith(s + ".") for n in names)}

    def published(self, spark) -> DataFrame | None:
        """Ids of the unfinished batch that are in the sink, or None if the last batch was committed."""
        planned, done = checkpoint.latest_offsets(spark, self.location), checkpoint.latest_committed_offsets(spark, self.location)
        if planned is None or done is not None and planned[0] == done[0]:
            return None
        (rt, rb), (wt, wb) = self.reader, self.writer
        end = offsets_by_partition(planned[1], rt)
        start = offsets_by_partition(done[1], rt) if done else {}
        options = {"kafka.request.timeout.ms": str(1000 * self.timeout_s)} if not rb.startswith("file:") else {}
        source = topic.read_batch(spark, rb, rt, {p: start.get(p, 0) for p in end}, end, **options)
        n = source.count()
        everything = topic.read_batch(spark, wb, wt, **options)
        ends = {r[0]: r[1] + 1 for r in everything.groupBy("partition").agg(F.max("offset")).collect()} if not wb.startswith("file:") else topic.end_offsets(topic.local_path(wb), wt)
        sink = topic.at_least_latest(spark, wb, wt, dict.fromkeys(ends, n), ends, **options)
        a = ids_of(source, self.source_ids, self._schemas(rt, self.source_ids), self.registry)
        b = ids_of(sink, self.sink_ids, self._schemas(wt, self.sink_ids), self.registry)
        found = a.join(b.distinct(), a.columns, "left_semi").distinct()
        path = f"{self.location.rstrip('/')}-published/{planned[0]}"
        found.write.mode("overwrite").parquet(path)
        return spark.read.schema(found.schema).parquet(path)

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        if fs.is_empty(spark, self.location) or (gone := self.published(spark)) is None:
            return df
        names = [n.split(".", 1)[1] if n.split(".")[0] in ("key", "value") and n not in df.columns else n for n in self.source_ids]
        keys = [f"__published{i}" for i in range(len(names))]
        gone = gone.toDF(*keys)
        same = None
        for n, k in zip(names, keys, strict=True):
            c = df[quoted(n)] == gone[k]
            same = c if same is None else same & c
        return df.join(gone, same, "left_anti")
