"""Helpers shared by the operators: written intermediates, size-checked broadcasts, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast; every caller has a shuffle join beyond it.
BROADCAST_ROWS = 250_000
#: Bytes of its files (by the optimizer's estimate) up to which it may be broadcast, whatever the length of its rows.
BROADCAST_BYTES = 64 << 20
#: Rows that a written file of small rows may hold where their number is known: fewer tasks and files for small tables.
FILE_ROWS = 250_000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder inside the cluster's shared checkpoint folder.

    The folder is read from ``spark.checkpoint.dir``; only a local master (as in tests) may leave it unset, for which a
    folder of our own under ``/tmp/checkpoints`` is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{(base or 'file:///tmp/checkpoints').rstrip('/')}/tributary/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """Write a DataFrame and read it back: cuts the lineage with files that survive the loss of any executor.

    ``rows``: about how many (small) rows it has at most, if that is known; it is written by as few tasks as they need.
    """
    few = df if rows is None else df.coalesce(1 + rows // FILE_ROWS)
    # Nobody waits for these files, so the driver need not create a marker that they are whole.
    few.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """The small result of a stage of many tasks, in a sixteenth of their number: fewer files to write and to read."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate that nothing reads any more, through the file system the session uses."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives Arrow's unused memory back after each batch and at its end: a worker lives
    on beside its executor, and Arrow would keep what earlier batches and tasks took."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in run(batches):
                yield batch
                del batch
                pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()

    return freed


def collected(spark: SparkSession) -> None:
    """Have each executor collect its garbage, which also gives the memory of an emptied heap back to the machine: a heap
    grows up to its limit while little in it is alive, and would stand at that beside the workers of whatever comes next.

    Tasks are dealt to idle executors in turn, so two for each reach them all; one that is missed keeps its garbage.
    """
    n = 2 * spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size()
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The (already written) side with a broadcast hint if it has at most ``most`` rows and ``BROADCAST_BYTES``, as it is otherwise."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES and df.limit(most + 1).count() <= most else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, path: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node with an edge.

    ``edges``: of a written table, two long columns ``a``, ``b``. Returns ``node``, ``component`` for nodes that have an edge to another
    node. Alternates large-star and small-star (a logarithmic number of rounds); each half takes the minimum with a
    partially aggregated groupBy and joins it back, so a hub's edges are never gathered in one task's memory. Every
    round is written to ``path``.
    """
    spark = edges.sparkSession

    def least_neighbour(e: DataFrame) -> DataFrame:
        # The key is an expression, so the join shuffles this (small) side anew: adaptive execution splits a hub's
        # partition only if both sides of the join come straight from an exchange, without the aggregate in between.
        return e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0)).alias("a"), "m")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least_neighbour(both).select("a", F.least("a", "m").alias("m"))
        return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        low = least_neighbour(e)
        moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct()

    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    rows = edges.count()
    e, seen, last = written(e, f"{path}/cc0", rows), None, f"{path}/cc0"
    for k in range(1, max_rounds + 1):
        now = f"{path}/cc{k}"
        nxt = written(small_star(large_star(e)), now, rows)
        removed(spark, last)
        e, last = nxt, now
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        # A forest of stars: every node has one parent, and a further round changed nothing.
        if tuple(sums) == seen:
            break
        seen, rows = tuple(sums), sums[0]
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
