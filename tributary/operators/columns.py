"""Column transformers. All take streaming and static DataFrames and add no exchange."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.registry import Context, Property, Transformer, component
from tributary.sources import checkpoint


@component("column-selector")
class ColumnSelector(Transformer):
    name = "Column selector"
    description = "Selects columns by name; * is all of them."
    properties = {"columns.to.select": Property("Columns", "comma-separated, default *", False)}

    def __init__(self, columns: list[str]):
        if not columns:
            raise ValueError("no columns to select")
        self.columns = columns

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> ColumnSelector:
        return cls(conf.list("columns.to.select", ["*"]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)


def _pairs(a: list[str], b: list[str]) -> None:
    if not a or len(a) != len(b):
        raise ValueError(f"as many source as target columns are needed, not {len(a)} and {len(b)}")


@component("column-renamer")
class ColumnRenamer(Transformer):
    name = "Column renamer"
    description = "Renames one after another, so a->b, b->c chain; a name that isn't there is left out."
    properties = {"columns.rename.from": Property("From"), "columns.rename.to": Property("To")}

    def __init__(self, from_: list[str], to: list[str]):
        _pairs(from_, to)
        self.renames = list(zip(from_, to, strict=True))

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> ColumnRenamer:
        return cls(conf.list("columns.rename.from"), conf.list("columns.rename.to"))

    def transform(self, df: DataFrame) -> DataFrame:
        for a, b in self.renames:
            df = df.withColumnRenamed(a, b)
        return df


def split_path(path: str) -> list[str]:
    """Parts of a dotted path; backticks hold dots together."""
    out, part, inside = [], "", False
    for c in path:
        if c == "`":
            inside = not inside
        elif c == "." and not inside:
            out.append(part)
            part = ""
        else:
            part += c
    if inside or not all([*out, part]):
        raise ValueError(f"malformed column path {path!r}")
    return [*out, part]


@component("column-copier")
class ColumnCopier(Transformer):
    name = "Column copier"
    description = "Copies columns to (nested) targets; a later copy to a path moves it to the end of its parent."
    properties = {"columns.copy.from": Property("From"), "columns.copy.to": Property("To")}

    def __init__(self, from_: list[str], to: list[str]):
        _pairs(from_, to)
        self.tree: dict = {}
        for a, b in zip(from_, to, strict=True):
            node, parts = self.tree, split_path(b)
            for p in parts[:-1]:
                below = node.pop(p, None)
                node[p] = below if isinstance(below, dict) else {}  # a leaf that gets children loses its value
                node = node[p]
            node.pop(parts[-1], None)
            node[parts[-1]] = a

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> ColumnCopier:
        return cls(conf.list("columns.copy.from"), conf.list("columns.copy.to"))

    def transform(self, df: DataFrame) -> DataFrame:
        def made(node: dict | str) -> Column:
            return F.col(node) if isinstance(node, str) else F.struct(*(made(v).alias(k) for k, v in node.items()))

        for name, node in self.tree.items():
            df = df.withColumn(name, made(node))
        return df


def _date(said: str | None) -> datetime.date:
    return datetime.date.fromisoformat(said) if said else datetime.date.today()


@component("date-version")
class AddDateVersion(Transformer):
    name = "Date and version columns"
    description = "Adds the ingestion date and a version, one above the greatest in the destination for that date. The lookup is made once, when the plan is built."
    properties = {"report.date": Property("Date", "yyyy-MM-dd, default today", False), "date.column": Property("Date column", "", False), "version.column": Property("Version column", "", False)}
    retained = {"writer.parquet.destination.directory": "destination.directory"}

    def __init__(self, report_date: str | None, destination: str, date_column: str = "ingest_date", version_column: str = "ingest_version"):
        self.date, self.destination, self.date_column, self.version_column = _date(report_date), destination, date_column, version_column

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> AddDateVersion:
        return cls(conf.get("report.date"), conf.require("destination.directory"), conf.get("date.column", "ingest_date"), conf.get("version.column", "ingest_version"))

    def next_version(self, spark) -> int:
        if not checkpoint.committed_files(spark, self.destination):
            return 1
        old = spark.read.parquet(self.destination).where(F.col(self.date_column) == F.lit(self.date))
        return (old.agg(F.max(F.col(self.version_column).cast("int"))).first()[0] or 0) + 1

    def transform(self, df: DataFrame) -> DataFrame:
        v = self.next_version(df.sparkSession)
        return df.withColumns({self.date_column: F.lit(self.date), self.version_column: F.lit(v)})


ERRORS = "array<struct<errType:string,errCode:string,errMsg:string,errCol:string,rawValues:array<string>,mappings:array<struct<mappingTableColumn:string,mappedDatasetColumn:string>>>>"


@component("audit-columns")
class AddAuditColumns(Transformer):
    name = "Audit columns"
    description = "Adds an empty error list, the information date as a date and as text, and version 1, in this order."
    properties = {"report.date": Property("Date", "yyyy-MM-dd, default today", False), "column.prefix": Property("Prefix", "of the date and version columns, default info", False)}

    def __init__(self, report_date: str | None, prefix: str = "info"):
        self.date, self.prefix = _date(report_date), prefix

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> AddAuditColumns:
        return cls(conf.get("report.date"), conf.get("column.prefix", "info"))

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.prefix
        return (df.withColumn("errCol", F.array().cast(ERRORS)).withColumn(f"{p}_date", F.lit(self.date))
                .withColumn(f"{p}_date_string", F.lit(self.date.isoformat())).withColumn(f"{p}_version", F.lit(1)))
