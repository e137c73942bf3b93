"""Avro's binary encoding, with schema resolution and the registry's framing (a zero byte, four bytes of schema id)."""

from __future__ import annotations

import datetime
import decimal
import struct

from tributary.errors import IncompatibleSchemaError
from tributary.functions.avro_schema import kind

EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
DAY = datetime.date(1970, 1, 1)
MICRO = datetime.timedelta(microseconds=1)


def frame(schema_id: int, body: bytes) -> bytes:
    return struct.pack(">bI", 0, schema_id) + body


def unframe(data: bytes) -> tuple[int, bytes]:
    if len(data) < 5 or data[0] != 0:
        raise ValueError("not a framed Avro message")
    return struct.unpack(">I", data[1:5])[0], data[5:]


def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _logical(s) -> str | None:
    return s.get("logicalType") if isinstance(s, dict) else None


def _matches(s, v) -> bool:
    k, logical = kind(s), _logical(s)
    if v is None or k == "null":
        return v is None and k == "null"
    tests = {"boolean": bool, "int": int, "long": int, "float": float, "double": float, "string": str, "enum": str, "bytes": (bytes, bytearray), "fixed": (bytes, bytearray), "array": list, "map": dict, "record": dict}
    if logical == "decimal":
        return isinstance(v, decimal.Decimal)
    if logical == "date":
        return isinstance(v, datetime.date) and not isinstance(v, datetime.datetime)
    if logical in ("timestamp-millis", "timestamp-micros"):
        return isinstance(v, datetime.datetime)
    if isinstance(v, bool):
        return k == "boolean"
    return isinstance(v, tests[k]) and not (k == "int" and not -(2**31) <= v < 2**31)


def encode(s, v) -> bytes:
    k, logical = kind(s), _logical(s)
    if k == "union":
        rest = [i for i, x in enumerate(s) if kind(x) != "null"]
        if isinstance(v, dict) and len(rest) > 1 and v.keys() == {f"member{n}" for n in range(len(rest))}:
            held = [n for n in range(len(rest)) if v[f"member{n}"] is not None]
            if len(held) != 1:
                raise ValueError(f"exactly one member of a union must be set, not {len(held)}")
            return _long(rest[held[0]]) + encode(s[rest[held[0]]], v[f"member{held[0]}"])
        i = next((i for i, x in enumerate(s) if _matches(x, v)), None)
        if i is None:
            raise ValueError(f"{v!r} fits no member of {s}")
        return _long(i) + encode(s[i], v)
    if v is None and k != "null":
        raise ValueError(f"null for the required type {k}")
    if k == "null":
        return b""
    if k == "record":
        return b"".join(encode(f["type"], v[f["name"]]) for f in s["fields"])
    if k == "array":
        return (_long(len(v)) + b"".join(encode(s["items"], x) for x in v) if v else b"") + b"\0"
    if k == "map":
        items = v.items() if isinstance(v, dict) else v
        return (_long(len(v)) + b"".join(encode("string", a) + encode(s["values"], b) for a, b in items) if v else b"") + b"\0"
    if k == "boolean":
        return b"\1" if v else b"\0"
    if logical == "decimal":
        n = int(v.scaleb(s.get("scale", 0), decimal.Context(prec=80)).to_integral_exact())
        if k == "fixed":
            return n.to_bytes(s["size"], "big", signed=True)
        b = n.to_bytes((n.bit_length() + 8) // 8 or 1, "big", signed=True)
        return _long(len(b)) + b
    if logical == "date":
        v = (v - DAY).days
    elif logical in ("timestamp-millis", "timestamp-micros"):
        v = (v if v.tzinfo else v.replace(tzinfo=datetime.UTC)) - EPOCH
        v = v // MICRO if logical == "timestamp-micros" else v // (1000 * MICRO)
    if k in ("int", "long"):
        return _long(v)
    if k == "float":
        return struct.pack("<f", v)
    if k == "double":
        return struct.pack("<d", v)
    if k == "string":
        b = v.encode()
        return _long(len(b)) + b
    if k == "bytes":
        return _long(len(v)) + bytes(v)
    if k == "fixed":
        if len(v) != s["size"]:
            raise ValueError(f"{len(v)} bytes for a fixed type of {s['size']}")
        return bytes(v)
    if k == "enum":
        return _long(s["symbols"].index(v))
    raise IncompatibleSchemaError(f"can't encode {k}")


class _In:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the message ends early")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def blocks(self):
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            yield from range(n)


def decode(writer, data: bytes, reader=None):
    """Value of a message of the writer's schema, as the reader's schema sees it."""
    source = _In(data)
    v = _read(writer, source)
    if source.at != len(data):
        raise ValueError(f"{len(data) - source.at} bytes follow the message")
    return resolve(v, writer, reader if reader is not None else writer)


class _Member:
    """A union's value with the branch it came from."""

    __slots__ = ("branch", "value")

    def __init__(self, branch: int, value):
        self.branch, self.value = branch, value


def _read(s, i: _In):
    k = kind(s)
    if k == "union":
        b = i.long()
        return _Member(b, _read(s[b], i))
    if k == "null":
        return None
    if k == "record":
        return {f["name"]: _read(f["type"], i) for f in s["fields"]}
    if k == "array":
        return [_read(s["items"], i) for _ in i.blocks()]
    if k == "map":
        return {_read("string", i): _read(s["values"], i) for _ in i.blocks()}
    if k == "boolean":
        return i.take(1) == b"\1"
    if k in ("int", "long"):
        return i.long()
    if k == "float":
        return struct.unpack("<f", i.take(4))[0]
    if k == "double":
        return struct.unpack("<d", i.take(8))[0]
    if k == "string":
        return i.take(i.long()).decode()
    if k == "bytes":
        return i.take(i.long())
    if k == "fixed":
        return i.take(s["size"])
    if k == "enum":
        return s["symbols"][i.long()]
    raise IncompatibleSchemaError(f"can't decode {k}")


_WIDER = {"int": ("int", "long", "float", "double"), "long": ("long", "float", "double"), "float": ("float", "double"), "string": ("string", "bytes"), "bytes": ("bytes", "string")}


def _fit(w, r) -> bool:
    a, b = kind(w), kind(r)
    return b in _WIDER.get(a, (a,))


def resolve(v, w, r):
    if kind(w) == "union":
        return resolve(v.value, w[v.branch], r)
    if kind(r) == "union":
        same = [i for i, x in enumerate(r) if kind(x) == kind(w)] or [i for i, x in enumerate(r) if _fit(w, x)]
        if not same:
            raise IncompatibleSchemaError(f"the reader's union has no {kind(w)}")
        rest = [i for i, x in enumerate(r) if kind(x) != "null"]
        out = resolve(v, w, r[same[0]])
        kinds = {kind(r[i]) for i in rest}
        if out is None or len(rest) < 2:
            return out
        if kinds in ({"int", "long"}, {"float", "double"}):
            return out
        return {f"member{n}": out if i == same[0] else None for n, i in enumerate(rest)}
    if not _fit(w, r):
        raise IncompatibleSchemaError(f"{kind(w)} can't be read as {kind(r)}")
    k, logical = kind(r), _logical(r)
    if k == "record":
        theirs = {f["name"]: f for f in w["fields"]}
        out = {}
        for f in r["fields"]:
            if f["name"] in theirs:
                out[f["name"]] = resolve(v[f["name"]], theirs[f["name"]]["type"], f["type"])
            elif "default" in f:
                first = f["type"][0] if isinstance(f["type"], list) else f["type"]
                out[f["name"]] = resolve(default(first, f["default"]), first, f["type"])
            else:
                raise IncompatibleSchemaError(f"field '{f['name']}' is neither written nor has a default")
        return out
    if k == "array":
        return [resolve(x, w["items"], r["items"]) for x in v]
    if k == "map":
        return {a: resolve(b, w["values"], r["values"]) for a, b in v.items()}
    if k in ("float", "double"):
        return float(v)
    if logical == "decimal":
        return decimal.Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-r.get("scale", 0), decimal.Context(prec=80))
    if logical == "date":
        return DAY + datetime.timedelta(days=v)
    if logical == "timestamp-micros":
        return EPOCH + v * MICRO
    if logical == "timestamp-millis":
        return EPOCH + v * 1000 * MICRO
    if k == "string" and isinstance(v, bytes):
        return v.decode()
    return v.encode() if k == "bytes" and isinstance(v, str) else v


def default(s, d):
    """A default's JSON as a raw value of its schema."""
    k = kind(s)
    if k == "union":
        return _Member(0, default(s[0], d))
    if k in ("bytes", "fixed"):
        return d.encode("latin-1")
    if k == "record":
        return {f["name"]: default(f["type"], d.get(f["name"], f.get("default"))) for f in s["fields"]}
    if k == "array":
        return [default(s["items"], x) for x in d]
    return {a: default(s["values"], b) for a, b in d.items()} if k == "map" else d

