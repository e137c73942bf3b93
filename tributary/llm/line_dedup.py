"""Line deduplication over levelled sorted runs of line hashes. DataFrame operations only.

A *run* is a table of line keys (two independent 64-bit hashes), bucketed and sorted by both, one file a bucket, with the
number of documents and the largest document id of each key. A batch is shuffled once by the key and written in the same
buckets; the anti-joins against the runs then merge sorted buckets, with no exchange and no sort above a run. What they
leave are the keys that no run has: the batch's own run. The other keys of the batch are kept as *increments*. When a
level has two runs they are merged into one of the next level, so a key is rewritten a logarithmic number of times.
Runs stay under their path with a versioned manifest and can be opened again for later batches.

Whether a line goes depends on its document's id and its key alone, so decisions are joined back by id and text (as two
hashes): rows that repeat an id are one document, and each loses only lines of its own.

Defined results: a null or empty text is one empty line; rows of one id are one document, which counts once for a key; rows
without an id are together one document that sorts below every other; repeated rows are treated alike; ids of any
orderable type; other columns pass through untouched, but for columns named n_lines and n_dropped, which are replaced; an
empty table gives an empty table; very long texts are linear in their lines.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import fs
from tributary.llm.common import gathered, maybe_broadcast, read_table, removed, scratch_dir, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Without it Spark doesn't report that a bucket of one file is sorted, and sorts it again.
ORDERED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside read a run's buckets in their order."""
    before = spark.conf.get(ORDERED_SCAN, None)
    spark.conf.set(ORDERED_SCAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(ORDERED_SCAN) if before is None else spark.conf.set(ORDERED_SCAN, before)


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased; other letters stay."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hashes(text: Column) -> list[Column]:
    """What a row is known by beside its id."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Per row: ``id``, t1 and t2 of its text, and ``lines``, the array of (pos, h1, h2) of its lines that are long enough."""
    keys = F.transform(split_lines(F.col(text_col)), lambda x: line_key(x))
    hashed = F.transform(
        keys,
        lambda x, i: F.when(
            F.length(x) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))
        ),
    )
    return docs.select(F.col(id_col).alias("id"), *text_hashes(F.col(text_col)), F.filter(hashed, lambda x: x.isNotNull()).alias("lines"))


def repeated_ids(lines: DataFrame) -> DataFrame:
    """Ids (null among them) of more than one row."""
    return lines.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("rid"), F.lit(True).alias("again"))


def key_counts(lines: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(h1, h2, n, top): in how many documents a key is, and the largest of them. Partially aggregated.

    ``repeated``: the result of ``repeated_ids``, for tables where ids repeat; their keys are made distinct by id first.
    """
    own = F.array_distinct(F.transform("lines", lambda x: F.struct(x.h1.alias("h1"), x.h2.alias("h2"))))

    def keys(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode(own).alias("k")).select("id", "k.*")

    if repeated is None:
        out = keys(lines)
    else:
        same = lines.id.eqNullSafe(repeated.rid)
        out = keys(lines.join(repeated, same, "left_anti")).unionByName(keys(lines.join(repeated, same, "left_semi")).distinct())
    return out.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("top"))


@dataclass
class LineRuns:
    """Levelled sorted runs below ``path``; ``add`` one batch after another, then ask for the ``shared`` keys.

    A key is in exactly one run, that of the first batch which had it. ``increments`` hold the counts of keys that later
    batches met again. A document must arrive whole in one batch. ``close`` takes the runs out of the session's catalog and
    leaves their files, which ``open`` finds again; ``drop`` deletes them.
    """

    spark: SparkSession
    path: str
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)
    increments: list[str] = field(default_factory=list)
    version: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """The runs that stand below a path, as of their newest manifest; none if there is no manifest."""
        found = [f for f in fs.files(spark, f"{path}/manifest") if f.endswith(".json")]
        if not found:
            return cls(spark, path)
        m = json.loads(fs.read_text(spark, max(found)))
        runs = cls(spark, path, m["buckets"], m["levels"], m["increments"], m["version"])
        for name in runs.tables():
            if not spark.catalog.tableExists(name):
                schema = spark.read.parquet(f"{path}/{name}").schema
                cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
                spark.sql(
                    f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) "
                    f"INTO {runs.buckets} BUCKETS LOCATION '{path}/{name}'"
                )
        return runs

    def tables(self) -> list[str]:
        return [n for level in self.levels for n in level] + self.increments

    def close(self) -> None:
        for name in self.tables():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        self.close()
        removed(self.spark, self.path)

    def _write(self, df: DataFrame, placed: bool = False) -> str:
        """A new table in the runs' buckets; ``placed``: its partitions are the buckets already."""
        name = f"line_run_{uuid.uuid4().hex}"
        df = df if placed else df.repartition(self.buckets, *KEY)
        with ordered_scans(self.spark):
            (
                df.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
                .option("path", f"{self.path}/{name}").saveAsTable(name)
            )
        return name

    def _gone(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            removed(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def unseen(self, batch: DataFrame, runs: list[DataFrame]) -> DataFrame:
        """Keys of a batch (in the runs' buckets) that none of ``runs`` has: one merge anti-join after another."""
        for run in runs:
            batch = batch.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, counts: DataFrame) -> None:
        """Merge-anti-join a batch's (h1, h2, n, top) with the runs and add what they don't have as a new run."""
        own = self._write(counts.select(*KEY, "n", "top"))
        if any(self.levels):
            batch = self.spark.table(own)
            run = self._write(self.unseen(batch, self.runs()), placed=True)
            self.increments.append(self._write(self.unseen(batch, [self.spark.table(run)]), placed=True))
            self._gone([own])
            own = run
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(own)
        old = self._compact()
        self.version += 1
        state = {"buckets": self.buckets, "levels": self.levels, "increments": self.increments, "version": self.version}
        if not fs.put_new(self.spark, f"{self.path}/manifest/{self.version:08d}.json", json.dumps(state)):
            raise RuntimeError(f"another writer added a batch to {self.path}; open the runs again and add this one")
        self._gone(old)  # only after the manifest stopped naming them

    def _compact(self) -> list[str]:
        """Merge levels of two runs upwards; returns the tables that were merged."""
        old: list[str] = []
        for k, level in enumerate(self.levels):
            if len(level) < 2:
                break
            merged = self._merge(level)
            old += level
            self.levels[k] = []
            if len(self.levels) == k + 1:
                self.levels.append([])
            self.levels[k + 1].append(merged)
        if old and len(self.increments) > 1:
            old += self.increments
            self.increments = [self._total()]
        return old

    def _merge(self, names: list[str]) -> str:
        """Two tables as one, by a full outer merge join of their buckets; counts of a key that both hold are added."""
        a, b = (self.spark.table(n) for n in names)
        both = a.alias("a").join(b.alias("b").hint("merge"), KEY, "full_outer")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return self._write(both.select(*KEY, n.alias("n"), F.greatest("a.top", "b.top").alias("top")), placed=True)

    def _total(self) -> str:
        """All increments as one new table."""
        first, *rest = self.increments
        total = first
        for name in rest:
            total, last = self._merge([total, name]), total
            self._gone([] if last == first else [last])
        return total

    def shared(self, min_docs: int, path: str) -> DataFrame:
        """Keys found in at least ``min_docs`` documents, with the largest document id that holds them, written to ``path``."""
        runs = self.runs()
        if not runs:
            raise ValueError("no batch was added")
        more = self._total() if self.increments else None
        out = None
        for r in runs:
            if more is not None:
                added = self.spark.table(more).select(*KEY, F.col("n").alias("n1"), F.col("top").alias("top1"))
                r = r.join(added.hint("merge"), KEY, "left")
                r = r.select(*KEY, (F.col("n") + F.coalesce("n1", F.lit(0))).alias("n"), F.greatest("top", "top1").alias("top"))
            part = r.where(F.col("n") >= min_docs).select(*KEY, "top")
            out = part if out is None else out.unionByName(part)
        with ordered_scans(self.spark):
            out = written(out, path)
        self._gone([more] if len(self.increments) > 1 else [])
        return out


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 3,
    runs: LineRuns | None = None,
) -> DataFrame:
    """``docs`` with the kept text in ``text_col`` plus ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose their lines everywhere but in the
    largest document id that holds them. The corpus is added in ``batches`` parts dealt by the id. With ``runs`` the
    documents are added to those, lines of earlier calls count, and the runs stay; without, runs of this call are deleted.
    """
    spark, path = docs.sparkSession, scratch_dir(docs.sparkSession)
    dealt = line_hashes(docs, id_col, text_col, min_chars).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    dealt.write.partitionBy("part").parquet(f"{path}/lines")
    lines = spark.read.schema(dealt.schema).parquet(f"{path}/lines")
    repeated = written(gathered(repeated_ids(lines)), f"{path}/repeated")
    repeated = maybe_broadcast(repeated) if repeated.take(1) else None
    mine = LineRuns(spark, f"{path}/runs") if runs is None else runs
    for k in range(batches):
        mine.add(key_counts(lines.where(F.col("part") == k), repeated))
    shared = maybe_broadcast(mine.shared(min_docs, f"{path}/shared"))
    mine.drop() if runs is None else mine.close()
    row = ["id", "t1", "t2"]
    drops = (
        lines.select(*row, F.explode("lines").alias("x")).select(*row, "x.*").join(shared, KEY)
        .where(~F.col("id").eqNullSafe(F.col("top"))).groupBy(*row).agg(F.sort_array(F.collect_set("pos")).alias("drops"))
        .select(F.struct("*").alias("__dropped"))
    )
    t1, t2 = text_hashes(F.col(text_col))
    d = F.col("__dropped")
    out = docs.join(drops, F.col(id_col).eqNullSafe(d["id"]) & t1.eqNullSafe(d["t1"]) & t2.eqNullSafe(d["t2"]), "left")
    out = out.withColumn("__lines", split_lines(F.col(text_col)))
    ends = F.concat(F.array(F.lit(-1)), F.coalesce(d["drops"], F.array().cast("array<int>")), F.array(F.size("__lines")))
    out = out.withColumn("__ends", ends)
    # What stands between two dropped lines is one slice, so the work is linear in the number of lines.
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("__ends") - 1),
            lambda i: F.slice("__lines", F.get("__ends", i - 1) + 2, F.get("__ends", i) - F.get("__ends", i - 1) - 1),
        )
    )
    return out.withColumns(
        {text_col: F.array_join(kept, "\n"), "n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__ends") - 2).cast("long")}
    ).drop("__dropped", "__lines", "__ends")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
     k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     d AS (SELECT k.*, s.key IS NOT NULL AND s.top <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
