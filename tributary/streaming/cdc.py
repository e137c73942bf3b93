"""CDC writers: each micro-batch is merged into a versioned table, exactly once."""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tributary.config import Config
from tributary.operators import cdc
from tributary.registry import Context, Property, Writer, component
from tributary.streaming.sinks import COMMON, trigger
from tributary.streaming.store import VersionedTable


class CdcWriter(Writer):
    prefix: ClassVar[str] = ""
    history: ClassVar[bool] = False

    def __init__(self, destination: str, when: dict, location: str, merge: cdc.Merge, partition_by: list[str] | None = None, options: dict[str, str] | None = None, buckets: int = 16):
        if not destination.strip():
            raise ValueError("the destination must not be blank")
        self.destination, self.when, self.location, self.merge, self.partition_by, self.options, self.buckets = destination, when, location, merge, partition_by or [], options or {}, buckets

    @classmethod
    def check(cls, conf: Config) -> None:
        own = ["destination.directory", "key.column", "operation.column", "operation.deleted.values", "precombineColumns"] + ["timestamp.column"] * cls.history
        for key in [*(f"{cls.prefix}.{k}" for k in own), "writer.common.checkpoint.location"]:
            conf.require(key)

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> CdcWriter:
        own = conf.subset(cls.prefix)
        pre = own.list("precombineColumns")
        orders = {c: tuple(own.list(f"precombineColumns.customOrder.{c}")) for c in pre if f"precombineColumns.customOrder.{c}" in own}
        merge = cdc.Merge(own.require("key.column"), own.require("operation.column"), tuple(own.list("operation.deleted.values")), tuple(pre), orders, own.get("timestamp.column"))
        return cls(own.require("destination.directory"), trigger(conf), conf.require("writer.common.checkpoint.location"), merge, own.list("partition.columns", []),
                   dict(own.subset("options")), own.number("buckets", 16))

    def table(self, df: DataFrame) -> VersionedTable:
        t = VersionedTable(df.sparkSession, self.destination)
        schema = cdc.scd2_schema(df.schema, self.merge.timestamp) if self.history else df.schema
        t.create_if_absent(schema, self.merge.key, self.partition_by, self.buckets)
        return t

    def merged(self, old: DataFrame, batch: DataFrame) -> DataFrame:
        return cdc.merge_scd2(old, batch, self.merge) if self.history else cdc.merge_snapshot(old, batch, self.merge)

    def write(self, df: DataFrame) -> StreamingQuery:
        table, who = self.table(df), self.location

        def one(batch: DataFrame, batch_id: int) -> None:
            table.merge(batch, self.merged, who, batch_id)

        return df.writeStream.trigger(**self.when).options(**self.options).option("checkpointLocation", self.location).foreachBatch(one).start()


def _properties(history: bool) -> dict[str, Property]:
    return {**COMMON, "destination.directory": Property("Destination"), "key.column": Property("Key"), "operation.column": Property("Operation"),
            "operation.deleted.values": Property("Deleting operations"), "precombineColumns": Property("Precombine columns"),
            **({"timestamp.column": Property("Timestamp")} if history else {})}


@component("cdc-snapshot-writer")
class SnapshotWriter(CdcWriter):
    name, description = "CDC to snapshot", "Keeps the latest row of each key."
    prefix, properties = "writer.deltacdctosnapshot", _properties(False)


@component("cdc-scd2-writer")
class HistoryWriter(CdcWriter):
    name, description = "CDC to history", "Keeps a slowly-changing-dimension (type 2) history of each key."
    prefix, history, properties = "writer.deltacdctoscd2", True, _properties(True)


@component("cdc-scd2-upsert-writer")
class UpsertHistoryWriter(HistoryWriter):
    name, description = "CDC to history by upsert", "The same history, under the settings of an upsert table keyed by (key, timestamp)."
    prefix = "writer.hudicdctoscd2"
