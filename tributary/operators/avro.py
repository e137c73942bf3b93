"""Avro decoding and encoding of topic records. The codec runs over Arrow batches; the schema it declares is exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tributary.config import Config
from tributary.functions import avro_codec as codec
from tributary.functions import avro_compiled as compiled
from tributary.functions import avro_schema as schemas
from tributary.functions import schema_registry as registries
from tributary.operators.cdc import quoted
from tributary.registry import Context, Property, Transformer, component

PREFIX, NAMES = "key.column.prefix", "key.column.names"


def _settings(conf: Config, is_key: bool) -> Config:
    """The ``key.*`` settings where given, else those of the value."""
    own, value = conf.subset("key.schema"), conf.subset("value.schema")
    return Config({**value, **own}) if is_key else value


def reader_schema(conf: Config, registry, topic: str, is_key: bool):
    """``schema.id`` is a number or ``latest``, which goes by the naming strategy."""
    s = _settings(conf, is_key)
    said = s.get("id", "latest")
    if said != "latest":
        return registry.by_id(int(said))
    return registry.latest(registries.subject(s.get("naming.strategy", "topic.name"), topic, s.get("record.name"), s.get("record.namespace"), is_key))[1]


def _decoded(column: str, reader, registry, dt: T.DataType, name: str):
    arrow = to_arrow_type(dt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders: dict[int, Callable] = {}  # compiled once for each schema that was written with
        to = schemas.parse(reader)
        for b in batches:
            out = []
            for m in b.column(b.schema.get_field_index(column)).to_pylist():
                if m is None:
                    out.append(None)
                    continue
                n, body = codec.unframe(m)
                if n not in decoders:
                    decoders[n] = compiled.decoder(schemas.parse(registry.by_id(n)), to)
                out.append(decoders[n](body))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, arrow)], names=[*b.schema.names, name])

    return run


def decode_column(df: DataFrame, column: str, reader, registry, name: str, dt: T.DataType | None = None) -> DataFrame:
    """Adds the decoded struct (of type ``dt``, that of the schema by default) of a framed binary column; null stays null."""
    dt = dt or schemas.to_spark(reader)
    return df.mapInArrow(_decoded(column, reader, registry, dt, name), T.StructType([*df.schema.fields, T.StructField(name, dt, True)]))


@component("avro-decoder")
class AvroDecoder(Transformer):
    name = "Confluent Avro decoder"
    description = "Decodes value (and key) against the reader schema, drops null payloads and flattens."
    properties = {"schema.registry.url": Property("Registry"), "value.schema.id": Property("Schema", "number or latest", False)}
    retained = {"reader.kafka.topic": "topic"}

    def __init__(self, value_schema, registry, key_schema=None, keep: list[str] | None = None, keep_nulls: bool = False, context: Context | None = None,
                 converter: schemas.Converter | None = None):
        self.value, self.registry, self.key, self.keep, self.keep_nulls, self.context = value_schema, registry, key_schema, keep or [], keep_nulls, context or Context()
        self.converter = converter or schemas.Converter()

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> AvroDecoder:
        r = registries.client(conf)
        keyed = conf.boolean("consume.keys")
        return cls(reader_schema(conf, r, conf.require("topic"), False), r, reader_schema(conf, r, conf.require("topic"), True) if keyed else None,
                   conf.list("keep.columns", []), conf.boolean("disable.nullability.preservation"), context, schemas.converter(conf.get("schema.converter")))

    def transform(self, df: DataFrame) -> DataFrame:
        value = self.converter.to_spark(self.value)
        key = self.converter.to_spark(self.key) if self.key is not None else T.StructType([])
        prefix, n = "key__", 0
        while any(f.name.startswith(prefix) for f in value):
            n += 1
            prefix = f"key{n}__"
        names = [*self.keep, *(prefix + f.name for f in key), *value.names]
        if len(set(names)) < len(names):
            raise ValueError(f"columns clash: {sorted({x for x in names if names.count(x) > 1})}")
        df = df.select(*map(quoted, self.keep), *(["key"] if self.key is not None else []), "value") if not {"key", "value"} & set(self.keep) else df
        v, k = "__decoded_value", "__decoded_key"
        df = decode_column(df, "value", self.value, self.registry, v, value)
        if self.key is not None:
            df = decode_column(df, "key", self.key, self.registry, k, key)
            self.context.put(PREFIX, prefix)
            self.context.put(NAMES, [prefix + f.name for f in key])
        if not self.keep_nulls:
            df = df.where(F.col(v).isNotNull())
        out = df.select(*map(quoted, self.keep), *(F.col(f"{k}.{quoted(f.name)}").alias(prefix + f.name, metadata=f.metadata) for f in key),
                        *(F.col(f"{v}.{quoted(f.name)}").alias(f.name, metadata=f.metadata) for f in value))
        if self.keep_nulls:
            return out
        # Required fields are required again: field access through a nullable struct had made them nullable.
        was = {f.name: f for f in df.schema}
        exact = T.StructType([*(was[c] for c in self.keep), *(T.StructField(prefix + f.name, f.dataType, True, f.metadata) for f in key), *value.fields])
        arrow = to_arrow_schema(exact)

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(b.columns, arrow, strict=True)], schema=arrow)

        return out.mapInArrow(same, exact)


def _encoded(schema, schema_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, head = compiled.encoder(schemas.parse(schema)), codec.frame(schema_id, b"")
        for b in batches:
            rows = b.column(0).to_pylist(maps_as_pydicts="strict")
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([None if r is None else head + encode(r) for r in rows], pa.binary())], names=[*b.schema.names[1:], "__out"])

    return run


def encode_struct(df: DataFrame, columns: list[str], names: list[str], schema, schema_id: int, out: str) -> DataFrame:
    """Replaces ``columns`` (under ``names``) by one framed binary column."""
    rest = [c for c in df.columns if c not in columns]
    packed = df.select(F.struct(*(F.col(quoted(c)).alias(n) for c, n in zip(columns, names, strict=True))).alias("__in"), *map(quoted, rest))
    kind = T.StructType([*packed.schema.fields[1:], T.StructField("__out", T.BinaryType(), True)])
    return packed.mapInArrow(_encoded(schema, schema_id), kind).withColumnRenamed("__out", out)


@component("avro-encoder")
class AvroEncoder(Transformer):
    name = "Confluent Avro encoder"
    description = "Generates and registers the schema of the rows and encodes them into value (and key)."
    properties = {"schema.registry.url": Property("Registry"), "value.schema.naming.strategy": Property("Naming strategy", "", False)}
    retained = {"writer.kafka.topic": "topic"}

    def __init__(self, topic: str, registry, conf: Config, with_key: bool = False, context: Context | None = None):
        self.topic, self.registry, self.conf, self.with_key, self.context = topic, registry, conf, with_key, context or Context()

    @classmethod
    def from_config(cls, conf: Config, context: Context) -> AvroEncoder:
        return cls(conf.require("topic"), registries.client(conf), conf, conf.boolean("produce.keys"), context)

    def register(self, fields: list[T.StructField], is_key: bool) -> tuple[object, int]:
        s = _settings(self.conf, is_key)
        name, ns = s.get("record.name", "topLevelRecord"), s.get("record.namespace", "")
        made = schemas.converter(self.conf.get("schema.converter")).from_spark(T.StructType(fields), name, ns)
        optional = self.conf.list(f"{'key' if is_key else 'value'}.optional.fields", [])
        made = schemas.with_optional(made, optional) if optional else made
        return made, self.registry.register(registries.subject(s.get("naming.strategy", "topic.name"), self.topic, name, ns, is_key), made)

    def transform(self, df: DataFrame) -> DataFrame:
        by = {f.name: f for f in df.schema}
        keys = self.context.get(NAMES, list) if self.with_key else []
        prefix = self.context.get(PREFIX, str) if self.with_key else ""
        values = [c for c in df.columns if c not in keys]
        schema, n = self.register([by[c] for c in values], False)
        out = encode_struct(df, values, values, schema, n, "value")
        if keys:
            names = [k.removeprefix(prefix) for k in keys]
            schema, n = self.register([T.StructField(x, by[k].dataType, by[k].nullable, by[k].metadata) for k, x in zip(keys, names, strict=True)], True)
            out = encode_struct(out, keys, names, schema, n, "key").select("key", "value")
        return out
