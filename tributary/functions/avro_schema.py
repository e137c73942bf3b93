"""Avro schemas (as parsed JSON) and Spark types, both ways, with nullability, defaults and logical types kept.

What Spark's types can't say travels in field metadata: ``avroType`` (the field's non-null Avro schema as JSON) and
``avroDefault`` (its default as JSON). Members of a union that is a struct in Spark are all nullable, since exactly one
of them holds a value.
"""

from __future__ import annotations

import copy
import json
from importlib import import_module

from pyspark.sql import types as T

from tributary.errors import IncompatibleSchemaError

TYPE, DEFAULT = "avroType", "avroDefault"
_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(),
          "bytes": T.BinaryType(), "fixed": T.BinaryType(), "enum": T.StringType(), "null": T.NullType()}


def kind(s) -> str:
    return "union" if isinstance(s, list) else s if isinstance(s, str) else s["type"] if isinstance(s["type"], str) else kind(s["type"])


def full_name(s: dict, ns: str | None) -> str:
    name = s["name"]
    space = s.get("namespace", ns)
    return name if "." in name or not space else f"{space}.{name}"


def parse(schema) -> object:
    """A schema from text or parsed JSON, with references to named types put in their place (recursion stays a name)."""
    named: dict[str, dict] = {}

    def walk(s, ns, open_):
        if isinstance(s, list):
            return [walk(x, ns, open_) for x in s]
        if isinstance(s, str):
            if s in _PLAIN:
                return s
            full = s if "." in s or not ns else f"{ns}.{s}"
            full = full if full in named or full in open_ else s
            if full in open_:
                return {"type": "recursive", "name": full}
            if full not in named:
                raise IncompatibleSchemaError(f"unknown Avro type {s!r}")
            return copy.deepcopy(named[full])
        if isinstance(s["type"], (dict, list)):
            return walk(s["type"], ns, open_)
        s = dict(s)
        if s["type"] == "record":
            name = full_name(s, ns)
            inner = name.rpartition(".")[0] or None
            s["fields"] = [{**f, "type": walk(f["type"], inner, open_ | {name})} for f in s["fields"]]
            named[name] = s
        elif s["type"] == "array":
            s["items"] = walk(s["items"], ns, open_)
        elif s["type"] == "map":
            s["values"] = walk(s["values"], ns, open_)
        elif s["type"] in ("fixed", "enum"):
            named[full_name(s, ns)] = s
        elif s["type"] not in _PLAIN:
            return walk(s["type"], ns, open_)
        return s

    return walk(json.loads(schema) if isinstance(schema, str) and schema.lstrip()[:1] in "{[\"" else schema, None, frozenset())


def to_spark(schema) -> T.DataType:
    return _to_spark(parse(schema))[0]


def _to_spark(s) -> tuple[T.DataType, bool]:
    """(type, nullable)"""
    k = kind(s)
    logical = s.get("logicalType") if isinstance(s, dict) else None
    if k == "recursive":
        raise IncompatibleSchemaError(f"recursive Avro type {s['name']}")
    if k == "union":
        rest = [x for x in s if kind(x) != "null"]
        null = len(rest) < len(s)
        if len(rest) == 1:
            return _to_spark(rest[0])[0], null
        kinds = {kind(x) for x in rest}
        if kinds == {"int", "long"}:
            return T.LongType(), null
        if kinds == {"float", "double"}:
            return T.DoubleType(), null
        return T.StructType([T.StructField(f"member{i}", _to_spark(x)[0], True, _metadata(x)) for i, x in enumerate(rest)]), null
    if k == "record":
        return T.StructType([_field(f) for f in s["fields"]]), False
    if k == "array":
        e, null = _to_spark(s["items"])
        return T.ArrayType(e, null), False
    if k == "map":
        v, null = _to_spark(s["values"])
        return T.MapType(T.StringType(), v, null), False
    if logical == "decimal" and k in ("bytes", "fixed"):
        return T.DecimalType(s["precision"], s.get("scale", 0)), False
    if logical == "date" and k == "int":
        return T.DateType(), False
    if logical in ("timestamp-millis", "timestamp-micros") and k == "long":
        return T.TimestampType(), False
    return _PLAIN[k], k == "null"


def _core(s):
    """The schema that a field's metadata keeps: without null, and an array's element."""
    if kind(s) == "union":
        rest = [x for x in s if kind(x) != "null"]
        return _core(rest[0]) if len(rest) == 1 else rest
    return _core(s["items"]) if kind(s) == "array" else s


def _metadata(s) -> dict:
    core = _core(s)
    return {TYPE: json.dumps(core)} if isinstance(core, dict) and (core.get("logicalType") or core["type"] in ("fixed", "bytes")) else {}


def _field(f: dict) -> T.StructField:
    dt, null = _to_spark(f["type"])
    meta = _metadata(f["type"])
    if "default" in f:
        meta[DEFAULT] = json.dumps(f["default"])
    return T.StructField(f["name"], dt, null, meta)


def decimal_bytes(precision: int) -> int:
    """Fewest bytes whose signed range holds every unscaled value of the precision."""
    n = 1
    while 2 ** (8 * n - 1) < 10**precision:
        n += 1
    return n


def from_spark(dt: T.DataType, nullable: bool = False, name: str = "topLevelRecord", namespace: str = "", metadata: dict | None = None):
    """The Avro schema of a Spark type. A nullable type is a union with null first, or last if it has a default."""
    meta = metadata or {}
    was = json.loads(meta[TYPE]) if TYPE in meta else None
    was = was if isinstance(was, dict) else {}
    space = f"{namespace}.{name}" if namespace else name
    if isinstance(dt, T.StructType):
        fields = []
        for f in dt.fields:
            a = {"name": f.name, "type": from_spark(f.dataType, f.nullable, f.name, space, f.metadata)}
            if DEFAULT in f.metadata:
                a["default"] = json.loads(f.metadata[DEFAULT])
            fields.append(a)
        out = {"type": "record", "name": name, **({"namespace": namespace} if namespace else {}), "fields": fields}
    elif isinstance(dt, T.ArrayType):
        out = {"type": "array", "items": from_spark(dt.elementType, dt.containsNull, name, namespace, {TYPE: meta[TYPE]} if TYPE in meta else None)}
    elif isinstance(dt, T.MapType):
        if not isinstance(dt.keyType, T.StringType):
            raise IncompatibleSchemaError("Avro maps have text keys")
        out = {"type": "map", "values": from_spark(dt.valueType, dt.valueContainsNull, name, namespace)}
    elif isinstance(dt, T.DecimalType):
        logical = {"logicalType": "decimal", "precision": dt.precision, "scale": dt.scale}
        if was.get("type") == "bytes":
            out = {"type": "bytes", **logical}
        else:
            out = {"type": "fixed", "name": was.get("name", "fixed"), "namespace": was.get("namespace", space), "size": max(was.get("size", 0), decimal_bytes(dt.precision)), **logical}
    elif isinstance(dt, T.BinaryType):
        out = {k: was[k] for k in ("type", "name", "namespace", "size") if k in was} if was.get("type") == "fixed" else "bytes"
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        out = {"type": "long", "logicalType": "timestamp-millis" if was.get("logicalType") == "timestamp-millis" else "timestamp-micros"}
    elif isinstance(dt, T.DateType):
        out = {"type": "int", "logicalType": "date"}
    elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType)):
        out = "int"
    else:
        out = next((k for k, v in _PLAIN.items() if v == dt and k not in ("enum", "fixed")), None)
        if out is None:
            raise IncompatibleSchemaError(f"Avro has no counterpart of {dt.simpleString()}")
    if not nullable:
        return out
    return [out, "null"] if json.loads(meta.get(DEFAULT, "null")) is not None else ["null", out]


def with_optional(schema, paths: list[str]):
    """A copy in which the fields at the dotted paths default to null, null being first in their union."""
    out = copy.deepcopy(schema)

    def records(s):
        if kind(s) == "union":
            for x in s:
                yield from records(x)
        elif kind(s) == "record":
            yield s
        elif kind(s) in ("array", "map"):
            yield from records(s["items" if kind(s) == "array" else "values"])

    for path in paths:
        *heads, last = path.split(".")
        at = list(records(out))
        for h in heads:
            at = [r for rec in at for f in rec["fields"] if f["name"] == h for r in records(f["type"])]
        fields = [f for rec in at for f in rec["fields"] if f["name"] == last]
        if not fields:
            raise ValueError(f"no field at '{path}'")
        for f in fields:
            union = f["type"] if isinstance(f["type"], list) else [f["type"]]
            if "null" not in union:
                raise ValueError(f"'{path}' is not nullable")
            f["type"], f["default"] = ["null", *(x for x in union if x != "null")], None
    return out


class Converter:
    """How Avro schemas become Spark types and the reverse; a plug-in subclasses it."""

    name = "default"

    def to_spark(self, schema) -> T.DataType:
        return to_spark(schema)

    def from_spark(self, row: T.StructType, name: str, namespace: str):
        return from_spark(row, False, name, namespace)


def converter(path: str | None) -> Converter:
    """The converter under an import path (``package.module.Class``); none is the default one."""
    if not path:
        return Converter()
    module, _, cls = path.rpartition(".")
    if not module:
        raise ValueError(f"'{path}' is no import path of a converter")
    made = getattr(import_module(module), cls)()
    if not isinstance(made, Converter):
        raise TypeError(f"{path} is no converter")
    return made
