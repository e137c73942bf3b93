"""Change-data-capture merges as functions over DataFrames: latest snapshot and type-2 history.

Everything is a join on the key or a window partitioned by it, so a merge shuffles each side once on the key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, CURRENT = "_start_date", "_end_date", "_is_current"


@dataclass(frozen=True)
class Merge:
    """Key, operation and precombine settings of a CDC stream; ``timestamp`` for histories only."""

    key: str
    operation: str
    deletes: tuple[str, ...]
    precombine: tuple[str, ...]
    orders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    timestamp: str | None = None


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(taken: list[str], name: str) -> str:
    """A column name that clashes with none."""
    while name in taken:
        name = "_" + name
    return name


def rank(df: DataFrame, m: Merge, column: str) -> Column:
    """The value, or its place in the column's custom order: unlisted is 0, null stays null."""
    c = df[quoted(column)]
    return F.array_position(F.array(*map(F.lit, m.orders[column])), c) if column in m.orders else c


def with_sort_columns(df: DataFrame, prefix: str, precombine: list[str], orders: dict[str, tuple[str, ...]]) -> DataFrame:
    m = Merge("", "", (), tuple(precombine), orders)
    return df.withColumns({f"{prefix}{c}": rank(df, m, c) for c in precombine})


def latest(df: DataFrame, m: Merge) -> DataFrame:
    """The latest change of each key by (precombine ranks, then all columns): one row a key, partially aggregated."""
    best = F.max(F.struct(*(rank(df, m, c).alias(f"r{i}") for i, c in enumerate(m.precombine)), F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")))
    return df.groupBy(F.col(quoted(m.key)).alias("k")).agg(best.alias("best")).where("best IS NOT NULL").select("best.row.*")


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """``df``, which fails where one of the columns is null."""
    bad = F.lit(False)
    for x in names:
        bad = bad | F.col(quoted(x)).isNull()
    error = F.raise_error(F.lit(f"null {' or '.join(names)} in a change")).cast("boolean")
    return df.where(F.when(bad, error).otherwise(F.lit(True)))


def merge_snapshot(current: DataFrame, batch: DataFrame, m: Merge, update_rule: str = "any") -> DataFrame:
    """The snapshot after a batch. A delete always removes; an update needs any precombine column to be greater
    (``any``), or the first that differs (``lexicographic``); an unmatched change inserts unless it deletes. Null keys are
    an error."""
    cols = batch.columns
    new = latest(keyed(batch, m.key), m)
    # A side that is absent is known by its struct and not by its key, so nulls inside rows can't be taken for absence.
    n = new.select(F.struct(*(F.col(quoted(x)) for x in cols)).alias("n"), F.col(quoted(m.key)).alias("nk"))
    c = current.select(F.struct(*(F.col(quoted(x)) for x in cols)).alias("c"), F.col(quoted(m.key)).alias("ck"))
    j = c.join(n, F.col("ck") == F.col("nk"), "full_outer")

    def place(side: str, x: str) -> Column:
        v = F.col(f"{side}.{quoted(x)}")
        return F.array_position(F.array(*map(F.lit, m.orders[x])), v) if x in m.orders else v

    greater = F.lit(False)
    for x in m.precombine if update_rule == "any" else reversed(m.precombine):
        more = F.coalesce(place("n", x) > place("c", x), F.lit(False))
        greater = greater | more if update_rule == "any" else more | (place("n", x).eqNullSafe(place("c", x)) & greater)
    gone = F.coalesce(F.col(f"n.{quoted(m.operation)}").isin(*m.deletes), F.lit(False))
    row = F.when(F.col("n").isNull(), F.col("c")).when(F.col("c").isNull(), F.col("n")).when(greater, F.col("n")).otherwise(F.col("c"))
    return j.where(F.col("n").isNull() | ~gone).select(row.alias("row")).select("row.*")


def scd2_schema(batch: T.StructType, timestamp: str) -> T.StructType:
    kind = batch[timestamp].dataType
    return T.StructType([T.StructField(START, kind, False), T.StructField(END, kind, True), T.StructField(CURRENT, T.BooleanType(), False), *batch.fields])


def merge_scd2(history: DataFrame | None, batch: DataFrame, m: Merge) -> DataFrame:
    """The whole history of the keys in ``batch`` (and of those in ``history``) after the batch.

    Events of one (key, timestamp) compete by precombine, nulls last; a full tie keeps the old row, then the row greatest
    in its remaining columns. Each row ends where the next begins; a delete is an empty interval; a null operation stays
    open and current. Null keys or timestamps are an error. Both windows are partitioned by the key: one exchange.
    """
    cols = batch.columns
    old, rn, nxt = (fresh(cols, x) for x in ("_is_old", "_place", "_next"))
    rows = batch.withColumn(old, F.lit(0))
    if history is not None:
        rows = rows.unionByName(history.select(*map(quoted, cols)).withColumn(old, F.lit(1)))
    ts, op = F.col(quoted(m.timestamp)), F.col(quoted(m.operation))
    rows = keyed(rows, m.key, m.timestamp)
    order = [rank(rows, m, c).desc_nulls_last() for c in m.precombine] + [F.col(old).desc()]
    order += [F.col(quoted(f.name)).desc_nulls_last() for f in batch.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = rows.withColumn(rn, F.row_number().over(Window.partitionBy(quoted(m.key), quoted(m.timestamp)).orderBy(*order))).where(F.col(rn) == 1)
    rows = rows.withColumn(nxt, F.lead(ts).over(Window.partitionBy(quoted(m.key)).orderBy(ts)))
    end = F.when(op.isNull(), F.lit(None)).when(op.isin(*m.deletes), ts).otherwise(F.col(nxt))
    return rows.select(ts.alias(START), end.alias(END), end.isNull().alias(CURRENT), *map(quoted, cols))
