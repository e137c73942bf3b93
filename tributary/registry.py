"""Components and how they are found: by a short alias, by import path, or through installed entry points."""

from __future__ import annotations

import importlib
import importlib.util
import logging
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from pathlib import Path
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tributary.config import Config

log = logging.getLogger(__name__)
GROUP = "tributary.components"


@dataclass(frozen=True)
class Property:
    label: str
    hint: str = ""
    required: bool = True


@dataclass
class Context:
    """Values that components of one pipeline share; ``get`` checks the type."""

    values: dict[str, object] = field(default_factory=dict)

    def put(self, key: str, value: object) -> None:
        self.values[key] = value

    def get(self, key: str, kind: type):
        if not isinstance(v := self.values.get(key), kind):
            raise KeyError(f"context has no {kind.__name__} '{key}'")
        return v


class Component(ABC):
    name: ClassVar[str] = ""
    description: ClassVar[str] = ""
    properties: ClassVar[dict[str, Property]] = {}
    #: Prefix below which every further key is passed on, or empty.
    extra_prefix: ClassVar[str] = ""
    #: Global keys that a transformer imports: global prefix -> key in its own configuration.
    retained: ClassVar[dict[str, str]] = {}

    @classmethod
    @abstractmethod
    def from_config(cls, conf: Config, context: Context): ...

    @classmethod
    def check(cls, conf: Config) -> None:
        for key, p in cls.properties.items():
            if p.required:
                conf.require(key)


class Reader(Component):
    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame: ...


class Transformer(Component):
    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...


class Writer(Component):
    @abstractmethod
    def write(self, df: DataFrame) -> StreamingQuery: ...


_known: dict[str, type[Component]] = {}


def component(alias: str):
    def add(cls: type[Component]) -> type[Component]:
        _known[alias] = cls
        return cls

    return add


def builtin() -> dict[str, type[Component]]:
    for m in ("sources.readers", "operators.columns", "operators.avro", "operators.dedup", "streaming.sinks", "streaming.cdc"):
        importlib.import_module(f"tributary.{m}")
    return dict(_known)


def load(name: str, kind: type[Component]) -> type[Component]:
    """A component class by alias or ``package.module.Class``."""
    found = builtin().get(name)
    if found is None:
        module, _, cls = name.rpartition(".")
        try:
            found = getattr(importlib.import_module(module), cls)
        except (ImportError, ValueError) as e:
            raise ValueError(f"component '{name}' was not found: {e}") from e
        except AttributeError as e:
            raise ValueError(f"'{module}' has no component '{cls}'") from e
    if not (isinstance(found, type) and issubclass(found, kind)):
        raise ValueError(f"'{name}' is not a {kind.__name__}")
    return found


def discover(folders: list[str] | None = None) -> dict[str, type[Component]]:
    """Built-in components, those of installed entry points, and those of the modules in ``folders``.

    A module that can't be imported is skipped with a warning; a folder that isn't one is an error."""
    out = builtin()
    for e in entry_points(group=GROUP):
        try:
            out[e.name] = e.load()
        except Exception as why:
            log.warning("entry point %s was skipped: %s", e.name, why)
    for folder in folders or []:
        if not Path(folder).is_dir():
            raise NotADirectoryError(folder)
        for file in sorted(Path(folder).glob("*.py")):
            spec = importlib.util.spec_from_file_location(f"_found_{file.stem}", file)
            module = importlib.util.module_from_spec(spec)
            try:
                spec.loader.exec_module(module)
            except Exception as why:
                log.warning("%s was skipped: %s", file, why)
                continue
            out |= {f"{file.stem}.{k}": v for k, v in vars(module).items() if isinstance(v, type) and issubclass(v, (Reader, Transformer, Writer)) and v.__module__ == module.__name__}
    return out
