"""A versioned table of Parquet files that is merged on read.

A table is a list of *segments* in order of age. The first is the base; every later one holds, for the keys of one batch, all
their rows as of that batch, and the list of those keys (so a key without rows is deleted). A row counts if no younger
segment lists its key. A merge therefore reads the rows of the batch's keys, and writes those alone: its output follows
the batch and not the table. Segments are compacted by size: when there are ``MAX_SEGMENTS`` of them, and whenever the younger ones
outgrow ``GROWTH`` of the base, so a row is rewritten a bounded number of times for each growth of the table by a half.
Rows are dealt by the key's hash into buckets (a partition folder each), and merges and reads of few keys touch theirs only.

Every version is a file of its own that is created exclusively (``versions/<n>.json``); the newest counts. Of two writers one
fails to create the version and merges again on top of the other's. A crash leaves the last version in place. The manifest
remembers the last batch of each query: a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import fs

BUCKET, AGE, KEY = "__bucket", "__age", "__key"
#: Younger segments that are kept apart, and the share of the base that they may come to.
MAX_SEGMENTS, GROWTH = 12, 0.5


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        return [f for f in fs.files(self.spark, f"{self.path}/versions") if f.endswith(".json") and not f.rsplit("/", 1)[1].startswith(".")]

    def exists(self) -> bool:
        return bool(self._versions())

    def manifest(self) -> dict:
        return json.loads(fs.read_text(self.spark, max(self._versions())))

    def _put(self, m: dict) -> bool:
        return fs.put_new(self.spark, f"{self.path}/versions/{m['version']:010d}.json", json.dumps(m))

    def create_if_absent(self, schema: T.StructType, key: str, partition_by: list[str] | None = None, buckets: int = 16) -> None:
        """Nothing if it is a table; an error if the folder holds other files."""
        if self.exists():
            return
        if not fs.is_empty(self.spark, self.path):
            raise ValueError(f"{self.path} is not empty and not a table")
        self._put({"version": 0, "schema": schema.json(), "key": key, "partition_by": partition_by or [], "n_buckets": buckets, "segments": [], "batches": {}})

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest()["schema"]))

    def _bucket(self, m: dict):
        return F.pmod(F.xxhash64(F.col(quoted(m["key"])).cast("string")), F.lit(m["n_buckets"])).cast("int")

    def _rows(self, m: dict, segments: list[dict], buckets: list[int] | None) -> DataFrame:
        """The rows of some segments that none of them outdates."""
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        full, key = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())]), schema[m["key"]]
        listed = T.StructType([T.StructField(KEY, key.dataType), T.StructField(BUCKET, T.IntegerType())])

        def part(folder: str, s: T.StructType, age: int) -> DataFrame:
            out = self.spark.read.schema(s).parquet(f"{self.path}/{folder}")
            out = out if buckets is None else out.where(F.col(BUCKET).isin(*buckets))
            return out.withColumn(AGE, F.lit(age))

        data, keys = None, None
        for age, segment in enumerate(segments):
            if segment["rows"]:
                more = part(segment["data"], full, age)
                data = more if data is None else data.unionByName(more)
            if segment["keys"] and age:
                more = part(segment["keys"], listed, age)
                keys = more if keys is None else keys.unionByName(more)
        columns = [F.col(quoted(f.name)) for f in schema]
        if data is None:
            return self.spark.createDataFrame([], schema)
        if keys is None:
            return data.select(*columns)
        last = keys.groupBy(KEY).agg(F.max(AGE).alias("__last"))
        return data.join(last, F.col(quoted(m["key"])) == F.col(KEY), "left").where(f"__last IS NULL OR {AGE} >= __last").select(*columns)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        m = self.manifest()
        return self._rows(m, m["segments"], buckets)

    def _write(self, m: dict, rows: DataFrame, keys: DataFrame | None) -> dict:
        """A segment; each bucket is written by one task (or by as many as its rows need)."""
        name = f"data/{m['version']:010d}-{uuid.uuid4().hex[:8]}"
        out = {"data": f"{name}/rows", "keys": f"{name}/keys" if keys is not None else ""}
        placed = rows.withColumn(BUCKET, self._bucket(m))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET, *m["partition_by"]).parquet(f"{self.path}/{out['data']}")
        stands = fs.files(self.spark, f"{self.path}/{out['data']}")
        out["rows"] = sum(1 for f in stands if f.endswith(".parquet"))
        if keys is not None:
            keys.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{out['keys']}")
        out["bytes"] = fs.size(self.spark, f"{self.path}/{name}")
        return out

    def merge(self, batch: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], query: str = "", batch_id: int | None = None) -> bool:
        """Replace the rows of the batch's keys by ``how(rows, batch)``; False if the batch was merged before."""
        batch = batch.persist(StorageLevel.DISK_ONLY)  # it is read for its keys and for the merge
        try:
            while True:
                m = self.manifest()
                if batch_id is not None and m["batches"].get(query, -1) >= batch_id:
                    return False
                m["version"] += 1
                key = quoted(m["key"])
                keys = batch.select(F.col(key).alias(KEY), self._bucket(m).alias(BUCKET)).distinct()
                if not batch.isEmpty():
                    touched = [r[0] for r in keys.select(BUCKET).distinct().collect()]  # at most ``n_buckets`` numbers
                    # Null keys go to the merge, which decides about them; no row of the table has one.
                    mine = self._rows(m, m["segments"], touched).join(keys.select(F.col(KEY).alias("__touched")), F.col(key) == F.col("__touched"), "left_semi")
                    m["segments"] = [*m["segments"], self._write(m, how(mine, batch), keys)]
                    m["segments"] = self._compacted(m)
                if batch_id is not None:
                    m["batches"][query] = batch_id
                if self._put(m):
                    return True
        finally:
            batch.unpersist()

    def _compacted(self, m: dict) -> list[dict]:
        base, *young = m["segments"]
        if not young:
            return m["segments"]
        if sum(s["bytes"] for s in young) > GROWTH * base["bytes"]:
            return [self._write(m, self._rows(m, m["segments"], None), None)]
        if len(young) < MAX_SEGMENTS:
            return m["segments"]
        keys, schema = None, T.StructType([T.StructField(KEY, T.StructType.fromJson(json.loads(m["schema"]))[m["key"]].dataType), T.StructField(BUCKET, T.IntegerType())])
        for s in young:
            more = self.spark.read.schema(schema).parquet(f"{self.path}/{s['keys']}")
            keys = more if keys is None else keys.unionByName(more)
        # The base stands in as an empty first segment, so that the keys of the oldest young one count.
        return [base, self._write(m, self._rows(m, [{"rows": 0, "keys": ""}, *young], None), keys.distinct())]

    def vacuum(self) -> int:
        """Delete data that the current version doesn't use; returns how many files went. Not beside a running merge."""
        used = {s["data"].rsplit("/", 1)[0] for s in self.manifest()["segments"]}
        gone = [f for f in fs.files(self.spark, f"{self.path}/data") if "data/" + f.split("/data/")[-1].split("/")[0] not in used]
        for f in gone:
            fs.delete(self.spark, f)
        return len(gone)
