"""A new package of components: ``python -m tributary.plans.scaffold <folder> <package>``.

Writes a reader, a transformer and a writer that run as they are, an entry point that makes them discoverable, and a
configuration that composes them.
"""

from __future__ import annotations

import keyword
import sys
from pathlib import Path

PROJECT = '''[project]
name = "{package}"
version = "0.1.0"
dependencies = ["pyspark>=4.0"]

[project.entry-points."tributary.components"]
{package} = "{package}.components"

[build-system]
requires = ["setuptools"]
build-backend = "setuptools.build_meta"
'''
COMPONENTS = '''"""Components of {package}: fill in what is marked."""

from pyspark.sql import functions as F

from tributary.registry import Property, Reader, Transformer, Writer


class {name}Reader(Reader):
    name, description = "{package} reader", "Counts, as many rows a second as asked for."
    properties = {{"reader.{package}.rows.per.second": Property("Rows a second")}}

    def __init__(self, rows):
        self.rows = rows

    @classmethod
    def from_config(cls, conf, context):
        return cls(conf.number("reader.{package}.rows.per.second", 1))

    def read(self, spark):  # your source
        return spark.readStream.format("rate").option("rowsPerSecond", self.rows).load()


class {name}Transformer(Transformer):
    name, description = "{package} transformer", "Adds a column."
    properties = {{"column": Property("Column", "its name")}}

    def __init__(self, column):
        self.column = column

    @classmethod
    def from_config(cls, conf, context):
        return cls(conf.require("column"))

    def transform(self, df):  # your columns
        return df.withColumn(self.column, F.lit(1))


class {name}Writer(Writer):
    name, description = "{package} writer", "Appends to a Parquet folder."
    properties = {{"writer.{package}.folder": Property("Folder"), "writer.common.checkpoint.location": Property("Checkpoint location")}}

    def __init__(self, folder, checkpoint):
        self.folder, self.checkpoint = folder, checkpoint

    @classmethod
    def from_config(cls, conf, context):
        return cls(conf.require("writer.{package}.folder"), conf.require("writer.common.checkpoint.location"))

    def write(self, df):  # your sink
        return df.writeStream.trigger(once=True).option("checkpointLocation", self.checkpoint).format("parquet").start(self.folder)
'''
CONFIG = '''component.reader={package}.components.{name}Reader
reader.{package}.rows.per.second=5
component.transformer.id.1=own
component.transformer.class.own={package}.components.{name}Transformer
transformer.own.column=added
component.writer={package}.components.{name}Writer
writer.{package}.folder=/tmp/{package}/out
writer.common.checkpoint.location=/tmp/{package}/checkpoint
'''


def scaffold(folder: str, package: str) -> Path:
    """The folder of the new project; an error where it holds files."""
    if not package.isidentifier() or keyword.iskeyword(package):
        raise ValueError(f"'{package}' is no package name")
    root, name = Path(folder) / package, "".join(x.capitalize() for x in package.split("_"))
    if root.exists() and any(root.iterdir()):
        raise ValueError(f"{root} is not empty")
    (root / package).mkdir(parents=True)
    (root / package / "__init__.py").write_text(f'"""Components of {package}."""\n')
    for path, text in ((f"{package}/components.py", COMPONENTS), ("pyproject.toml", PROJECT), (f"{package}.properties", CONFIG)):
        (root / path).write_text(text.format(package=package, name=name))
    return root


if __name__ == "__main__":
    print(scaffold(*sys.argv[1:3]))
