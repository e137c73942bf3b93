import datetime
import decimal
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import queries as Q
from tributary import registry
from tributary.config import Config, EnvSecrets, resolve_secrets
from tributary.errors import IncompatibleSchemaError, IngestionStartError
from tributary.functions import avro_codec as codec
from tributary.functions import avro_compiled as compiled
from tributary.functions import avro_schema as schemas
from tributary.functions import schema_registry as registries
from tributary.operators import avro, cdc, columns, dedup
from tributary.plans import pipeline
from tributary.sources import checkpoint, topic
from tributary.sources.readers import KafkaReader, ParquetReader
from tributary.streaming.sinks import DocumentWriter, KafkaWriter, ParquetWriter, trigger
from tributary import fs
from tributary.streaming import store
from tributary.streaming.store import VersionedTable

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name]).df()
    got = Q.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want))


#: Queries with a registry, a topic or a folder of documents, which go by the scheme of their paths.
BY_SCHEME = (
    "avro_keep_columns",
    "avro_roundtrip_value",
    "naming_strategies",
    "retry_without_dedup",
    "avro_rich_rows",
    "dedup_after_failed_batch",
    "null_payloads",
    "topic_passthrough",
    "avro_roundtrip_keyvalue",
    "document_sink",
    "optional_fields",
)


@pytest.mark.parametrize("name", BY_SCHEME)
def test_checkpoint_folder_without_scheme(spark, tmp_path, monkeypatch, name):
    get = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: str(tmp_path) if key == "spark.checkpoint.dir" else get(self, key, *default))
    test_query_equals_its_sql(spark, name)
    assert Q.work(spark).startswith(f"file:{tmp_path}/")


def test_config():
    c = Config.from_lines(["a.b = x=y ", "# no", "list = p, q", "ref=${a.b}!", "empty=", "my.password=s"])
    assert c["a.b"] == "x=y" and c.list("list") == ["p", "q"] and c["ref"] == "x=y!" and c["empty"] == ""
    assert c.redacted()["my.password"] == "*****" and dict(c.subset("a")) == {"b": "x=y"}
    with pytest.raises(ValueError):
        c.require("empty")
    with pytest.raises(ValueError):
        Config({"x": "1"}).with_retained(c, {"a.b": "x"})
    assert Config({}).with_retained(c, {"a": "z"})["z.b"] == "x=y"
    import os

    os.environ["TRIB_TEST"] = "v"
    assert resolve_secrets(Config({"k": "secret:env:TRIB_TEST"}), {"env": EnvSecrets()})["k"] == "v"
    with pytest.raises(ValueError):
        Config({"a": "${b}", "b": "${a}"})["a"]


def test_triggers_and_registry(tmp_path):
    assert trigger(Config({})) == {"once": True}
    assert trigger(Config({"writer.common.trigger.type": "processingtime"})) == {"processingTime": "0 milliseconds"}
    with pytest.raises(ValueError):
        trigger(Config({"writer.common.trigger.type": "sometimes"}))
    assert registry.load("column-selector", registry.Transformer) is columns.ColumnSelector
    assert registry.load("tributary.operators.columns.ColumnCopier", registry.Transformer) is columns.ColumnCopier
    with pytest.raises(ValueError):
        registry.load("column-selector", registry.Reader)
    (tmp_path / "bad.py").write_text("raise RuntimeError()")
    (tmp_path / "good.py").write_text("from tributary.registry import Transformer\nclass Mine(Transformer):\n    @classmethod\n    def from_config(cls, conf, context): return cls()\n    def transform(self, df): return df\n")
    assert "good.Mine" in registry.discover([str(tmp_path)])
    with pytest.raises(NotADirectoryError):
        registry.discover([str(tmp_path / "none")])


def test_pipeline_from_configuration(spark, tmp_path):
    conf = Config({
        "component.reader": "parquet-reader", "reader.parquet.source.directory": f"{SF}/nation*.parquet", "component.writer": "parquet-writer",
        "component.transformer.id.2": "ren", "component.transformer.id.-1": "sel", "component.transformer.class.sel": "column-selector", "component.transformer.class.ren": "column-renamer",
        "transformer.sel.columns.to.select": "n_nationkey,n_name", "transformer.ren.columns.rename.from": "n_name", "transformer.ren.columns.rename.to": "name",
        "writer.parquet.destination.directory": f"{tmp_path}/out", "writer.common.checkpoint.location": f"{tmp_path}/cp", "ingestor.spark.termination.method": "processAllAvailable"})
    pipeline.run(spark, conf)
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["n_nationkey", "name"] and spark.read.parquet(f"{tmp_path}/out").count() == 25
    with pytest.raises(IngestionStartError):
        pipeline.run(spark, Config({"component.reader": "parquet-reader"}))
    # A stray file is refused by the consistency check.
    spark.range(3).write.parquet(f"{tmp_path}/out/p=1")
    assert len(checkpoint.uncommitted_files(spark, f"{tmp_path}/out")) >= 1
    with pytest.raises(RuntimeError):
        ParquetWriter(f"{tmp_path}/out", {"once": True}, f"{tmp_path}/cp2", check=True).write(ParquetReader(f"{SF}/nation*.parquet").read(spark))


def test_document_writer(spark, tmp_path):
    w = DocumentWriter({"once": True}, f"{tmp_path}/cp", f"file:{tmp_path}/docs", "db", "c")
    pipeline.finish(w.write(ParquetReader(f"{SF}/region*.parquet").read(spark)))
    assert spark.read.json(f"{tmp_path}/docs/db/c").count() == 5
    with pytest.raises(ValueError):
        DocumentWriter({}, "x", "http://y")


def test_copy_rules(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = columns.ColumnCopier(["a", "b", "c", "a"], ["t.x", "t.y", "t.x", "`q.r`.s"]).transform(df)
    assert out.select("t").schema["t"].dataType.names == ["y", "x"] and out.first()["t"]["x"] == 3 and out.columns[-1] == "q.r"
    with pytest.raises(ValueError):
        columns.ColumnCopier(["a"], [])
    assert columns.ColumnRenamer(["a", "b"], ["b2", "b3"]).transform(df).columns == ["b2", "b3", "c"]


M = cdc.Merge("id", "op", ("gone",), ("op",), {"op": ("seen", "before", "after", "gone")}, "ts")


def test_scd2_increments_equal_one_recompute(spark):
    r = random.Random(4)
    day = datetime.datetime(2024, 1, 1)
    rows = [(f"k{k}", day + datetime.timedelta(days=r.randint(0, 6)), r.choice(["seen", "before", "after", "gone", None]), i, r.randint(0, 2)) for i, k in enumerate(r.randint(0, 200) for _ in range(1500))]
    df = spark.createDataFrame(rows, "id string, ts timestamp, op string, rank int, b int")
    m = cdc.Merge("id", "op", ("gone",), ("op", "rank"), M.orders, "ts")  # also a user column called rank
    whole = cdc.merge_scd2(None, df, m)
    step = None
    for b in range(3):
        step = cdc.merge_scd2(step, df.where(f"b = {b}"), m).cache()
        again = cdc.merge_scd2(step, df.where(f"b = {b}"), m)
        assert again.exceptAll(step).isEmpty() and step.exceptAll(again).isEmpty()
    assert whole.exceptAll(step).isEmpty() and step.exceptAll(whole).isEmpty()
    bad = step.where("(op = 'gone' AND _end_date <> _start_date) OR _is_current <> (_end_date IS NULL) OR (op IS NULL AND NOT _is_current)")
    assert bad.isEmpty()
    with pytest.raises(Exception, match="null id or ts"):
        cdc.merge_scd2(None, spark.createDataFrame([(None, day, "seen", 1, 0)], df.schema), m).collect()


def test_snapshot_rules(spark):
    m = cdc.Merge("id", "op", ("gone",), ("ts", "op"), M.orders)
    cur = spark.createDataFrame([("a", 5, "seen"), ("b", 5, "seen"), ("c", 5, "after"), ("d", 5, "after")], "id string, ts int, op string")
    new = spark.createDataFrame([("a", 1, "gone"), ("b", 4, "after"), ("c", 4, "seen"), ("e", 1, None), ("f", 1, "gone"), ("d", 6, "odd")], cur.schema)
    assert sorted(map(tuple, cdc.merge_snapshot(cur, new, m).collect())) == [("b", 4, "after"), ("c", 5, "after"), ("d", 6, "odd"), ("e", 1, None)]
    assert ("b", 5, "seen") in [tuple(r) for r in cdc.merge_snapshot(cur, new, m, "lexicographic").collect()]


def test_table_store(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t")
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k long, p int")
    t.create_if_absent(df.schema, "k", ["p"], 4)
    t.create_if_absent(df.schema, "k")
    assert t.read().count() == 0
    assert t.merge(df, lambda old, b: b, "q", 0) and not t.merge(df, lambda old, b: old, "q", 0)
    assert t.merge(df.where("k = 7"), lambda old, b: old.where("k <> 7"), "q", 1)
    assert sorted(r.k for r in t.read().collect()) == [i for i in range(50) if i != 7] and t.read().columns == ["k", "p"]
    assert t.merge(df, lambda old, b: b, "q", 2) and t.read().count() == 50  # as large as the base: compacted
    assert len(t.manifest()["segments"]) == 1 and t.vacuum() > 0 and t.read().count() == 50
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(ValueError):
        VersionedTable(spark, f"{tmp_path}/other").create_if_absent(df.schema, "k")


def test_table_merges_many_batches_like_one_map(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MAX_SEGMENTS", 3)
    monkeypatch.setattr(store, "GROWTH", 4)  # files of few rows are mostly overhead
    r, want = random.Random(3), {}
    t = VersionedTable(spark, f"{tmp_path}/t")
    schema = T.StructType.fromDDL("k string, v int")
    t.create_if_absent(schema, "k", [], 4)
    sizes = [400, *[12] * 9, 300, 5]
    segments = []
    for b, n in enumerate(sizes):
        rows = {f"k{r.randint(0, 300)}": None if r.random() < 0.2 else r.randint(0, 99) for _ in range(n)}
        df = spark.createDataFrame(list(rows.items()), schema)
        assert t.merge(df, lambda old, new: new.where("v IS NOT NULL"), "q", b) and not t.merge(df, lambda old, new: old, "q", b)
        want = {k: v for k, v in {**want, **rows}.items() if v is not None}
        assert {x.k: x.v for x in t.read().collect()} == want and t.read().count() == len(want)
        segments.append(len(t.manifest()["segments"]))
    assert max(segments) > 2 and segments[-1] < len(sizes)
    t.vacuum()
    assert {x.k: x.v for x in t.read().collect()} == want


def test_table_loses_no_update_of_two_writers(spark, tmp_path):
    one, two = VersionedTable(spark, f"{tmp_path}/t"), VersionedTable(spark, f"{tmp_path}/t")
    row = lambda k: spark.createDataFrame([(k,)], "k long")
    one.create_if_absent(row(1).schema, "k")
    calls = []

    def slow(old, new):
        calls.append(1)
        if len(calls) == 1:
            two.merge(row(2), lambda old, new: new, "two", 0)  # the other writer comes first
        return new

    assert one.merge(row(1), slow, "one", 0) and len(calls) == 2
    assert sorted(r.k for r in one.read().collect()) == [1, 2] and one.manifest()["version"] == 2
    assert not fs.put_new(spark, f"{tmp_path}/t/versions/{2:010d}.json", "{}") and one.read().count() == 2


def test_snapshot_refuses_a_null_key(spark):
    m = cdc.Merge("id", "op", ("gone",), ("ts", "op"), M.orders)
    cur = spark.createDataFrame([("a", 5, "seen")], "id string, ts int, op string")
    with pytest.raises(Exception, match="null id in a change"):
        cdc.merge_snapshot(cur, spark.createDataFrame([(None, 1, "after")], cur.schema), m).collect()
    empty = cdc.merge_snapshot(cur, spark.createDataFrame([("a", None, None)], cur.schema), m).collect()
    assert [tuple(r) for r in empty] == [("a", 5, "seen")]


RECORD = {"type": "record", "name": "r", "namespace": "n", "fields": [
    {"name": "b", "type": "boolean"}, {"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}, {"name": "s", "type": ["string", "null"], "default": "abcd"},
    {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "precision": 8, "scale": 3}}, {"name": "x", "type": {"type": "fixed", "name": "f", "size": 2}},
    {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "day", "type": {"type": "int", "logicalType": "date"}},
    {"name": "a", "type": {"type": "array", "items": ["null", "double"]}}, {"name": "m", "type": {"type": "map", "values": "float"}},
    {"name": "u", "type": ["null", "boolean", "int", "double"]}, {"name": "w", "type": ["int", "long"]}]}


def test_avro_schemas_and_codec(spark):
    dt = schemas.to_spark(RECORD)
    assert dt["d"].dataType == T.DecimalType(8, 3) and dt["w"].dataType == T.LongType() and dt["u"].dataType.names == ["member0", "member1", "member2"]
    back = schemas.from_spark(dt, False, "r", "n")
    kinds = {f["name"]: f["type"] for f in back["fields"]}
    assert kinds["s"] == ["string", "null"] and kinds["d"]["type"] == "bytes" and kinds["x"]["size"] == 2 and kinds["t"]["logicalType"] == "timestamp-millis"
    v = {"b": True, "i": -3, "l": None, "s": "é", "d": decimal.Decimal("-12.345"), "x": b"ab", "t": datetime.datetime(2024, 2, 29, 1, 2, 3, 4000, datetime.UTC), "day": datetime.date(1969, 12, 31),
         "a": [1.5, None], "m": {"k": 0.5}, "u": {"member0": None, "member1": 7, "member2": None}, "w": 2**40}
    s = schemas.parse(RECORD)
    assert codec.decode(s, codec.encode(s, v)) == v
    more = schemas.parse({**RECORD, "fields": [RECORD["fields"][1], {"name": "new", "type": "string", "default": "z"}, {"name": "i2", "type": ["null", "int"], "default": None}]})
    assert codec.decode(s, codec.encode(s, v), more) == {"i": -3, "new": "z", "i2": None}
    with pytest.raises(IncompatibleSchemaError):
        schemas.to_spark({"type": "record", "name": "q", "fields": [{"name": "c", "type": ["null", "q"]}]})
    assert schemas.with_optional(back, ["l"])["fields"][2] == {"name": "l", "type": ["null", "long"], "default": None}
    assert schemas.decimal_bytes(2) == 1 and schemas.decimal_bytes(3) == 2 and schemas.decimal_bytes(38) == 16
    jvm = spark._jvm.org.apache.spark.sql.avro.SchemaConverters.toSqlType(spark._jvm.org.apache.avro.Schema.Parser().parse('{"type":"record","name":"r","fields":[{"name":"i","type":"int"},{"name":"l","type":["null","long"]}]}'))
    ours = schemas.to_spark({"type": "record", "name": "r", "fields": [{"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}]})
    assert T.StructType.fromJson(json.loads(jvm.dataType().json())) == ours


def test_compiled_codec_equals_the_plain_one():
    r = random.Random(8)
    s = schemas.parse(RECORD)
    day = datetime.datetime(2024, 2, 29, tzinfo=datetime.UTC)
    enc, dec = compiled.encoder(s), compiled.decoder(s, s)
    newer = schemas.parse({**RECORD, "fields": [RECORD["fields"][11], RECORD["fields"][1] | {"type": "double"}, {"name": "new", "type": "string", "default": "z"}, RECORD["fields"][10]]})
    narrow = compiled.decoder(s, newer)
    for _ in range(300):
        member = r.choice([("member0", True), ("member1", -5), ("member2", 0.25), None])
        v = {"b": r.random() < 0.5, "i": r.randint(-(2**31), 2**31 - 1), "l": r.choice([None, 0, -1, 2**62]), "s": r.choice([None, "", "\u00e9" * r.randint(1, 200)]),
             "d": decimal.Decimal(r.randint(-99999, 99999)).scaleb(-3), "x": b"ab", "t": day + datetime.timedelta(milliseconds=r.randint(0, 10**9)), "day": datetime.date(1969, 12, 31),
             "a": [r.choice([None, 1.5]) for _ in range(r.randint(0, 3))], "m": {f"k{i}": 0.5 for i in range(r.randint(0, 3))},
             "u": member and {"member0": None, "member1": None, "member2": None, member[0]: member[1]}, "w": r.choice([3, 2**40])}
        b = enc(v)
        assert b == codec.encode(s, v) and dec(b) == codec.decode(s, b) == v and narrow(b) == codec.decode(s, b, newer)
        for cut in (b[:-1], b + b"\0"):
            with pytest.raises(ValueError):
                dec(cut)
    with pytest.raises(ValueError):
        enc(v | {"i": None})
    with pytest.raises(IncompatibleSchemaError):
        compiled.decoder(schemas.parse("string"), schemas.parse("int"))
    late = compiled.decoder(schemas.parse(["null", "string"]), schemas.parse(["null", "int"]))  # an error for strings alone
    assert late(b"\0") is None
    with pytest.raises(IncompatibleSchemaError):
        late(b"\2\2a")


def test_subjects_and_decoder_rules(spark, tmp_path):
    assert registries.subject("topic.name", "t", None, None, True) == "t-key" and registries.subject("topic.record.name", "t", "r", "n", False) == "t-n.r"
    r = registries.FileRegistry(str(tmp_path))
    df = spark.createDataFrame([(1, "a")], T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("key__x", T.StringType())]))
    sent = avro.AvroEncoder("t", r, Config({})).transform(df)
    nulls = sent.unionByName(spark.createDataFrame([(None,)], "value binary"))
    out = avro.AvroDecoder(r.latest("t-value")[1], r).transform(nulls)
    assert out.count() == 1 and out.schema["id"].nullable is False
    assert avro.AvroDecoder(r.latest("t-value")[1], r, keep_nulls=True).transform(nulls).count() == 2
    keyed = avro.AvroDecoder(r.latest("t-value")[1], r, r.latest("t-value")[1]).transform(sent.withColumn("key", F.col("value")))
    assert "key1__id" in keyed.columns
    with pytest.raises(ValueError):
        avro.AvroDecoder(r.latest("t-value")[1], r, keep=["id"]).transform(sent.withColumn("id", F.lit(1)))


def test_topic_reads(spark, tmp_path):
    d = str(tmp_path)
    topic.create_topic(d, "t", 2)
    topic.append(d, "t", 0, [(b"k", b"%d" % i) for i in range(10)])
    assert topic.end_offsets(d, "t") == {0: 10, 1: 0}
    assert sorted(r.offset for r in topic.read_batch(spark, f"file:{d}", "t", {0: 3}, {0: 6}).collect()) == [3, 4, 5]
    assert topic.at_least_latest(spark, f"file:{d}", "t", {0: 4, 1: 4}, {0: 10, 1: 0}).count() == 4
    with pytest.raises(Exception, match="beyond its end"):
        topic.read_batch(spark, f"file:{d}", "t", {}, {0: 99}).collect()


@pytest.mark.parametrize("deduplicate", [True, False])
def test_dedup_after_a_failed_batch(spark, tmp_path, deduplicate):
    d = f"{tmp_path}/topics"
    for t, n in (("in", 3), ("out", 2)):
        topic.create_topic(d, t, n)
    topic.register(spark)
    r = registries.FileRegistry(f"{tmp_path}/registry")

    def send(a, b):
        avro.AvroEncoder("in", r, Config({})).transform(spark.range(a, b).withColumnRenamed("id", "record_id")).write.format("topic").mode("append").option("path", d).option("topic", "in").save()

    def run():
        step = dedup.TopicDeduplicator(("in", f"file:{d}"), ("out", f"file:{d}"), f"{tmp_path}/cp", ["value.record_id"], ["value.record_id"], r, lambda t, key: r.latest(f"{t}-value")[1])
        steps = [avro.AvroDecoder(r.latest("in-value")[1], r), *([step] if deduplicate else []), avro.AvroEncoder("out", r, Config({}))]
        pipeline.finish(pipeline.start(spark, KafkaReader("in", f"file:{d}", f"{tmp_path}/cp"), steps, KafkaWriter("out", f"file:{d}", f"{tmp_path}/cp", {"once": True})))

    send(0, 20)
    run()
    send(20, 50)
    run()
    (tmp_path / "cp" / "commits" / "1").unlink()  # the batch was written but not committed
    for f in (tmp_path / "cp" / "commits").glob(".1.crc"):
        f.unlink()
    assert checkpoint.latest_offsets(spark, f"{tmp_path}/cp")[0] == 1 and checkpoint.latest_committed_offsets(spark, f"{tmp_path}/cp")[0] == 0
    run()
    out = avro.AvroDecoder(r.latest("out-value")[1], r).transform(topic.read_batch(spark, f"file:{d}", "out"))
    assert out.count() == (50 if deduplicate else 80) and out.distinct().count() == 50


def test_date_version_rejects_bad_date():
    with pytest.raises(ValueError):
        columns.AddDateVersion("2024-13-01", "x")


def test_batches_are_limited():
    assert topic.limited({0: 0, 1: 5}, {0: 100, 1: 5}, 10) == {0: 10, 1: 5}
    assert topic.limited({}, {0: 3, 1: 3}, 10) == {0: 3, 1: 3}
    assert topic.limited({0: 0, 1: 0, 2: 0}, {0: 9, 1: 1, 2: 1}, 1) == {0: 1, 1: 0, 2: 0}
    at, ends = {0: 0, 1: 0}, {0: 7, 1: 30}
    for _ in range(10):
        nxt = topic.limited(at, ends, 4)
        assert at == ends or 0 < sum(nxt.values()) - sum(at.values()) <= 4
        at = nxt
    assert at == ends


def test_http_registry(tmp_path):
    """The REST client against a small server: registration, look-ups, credentials, passed-on options."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen, schemas_ = [], {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            text = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def do_POST(self):  # noqa: N802
            seen.append((self.path, self.headers["Authorization"], self.headers["X-Team"]))
            schemas_[len(schemas_) + 1] = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["schema"]
            self.answer({"id": len(schemas_)})

        def do_GET(self):  # noqa: N802
            n = int(self.path.rsplit("/", 1)[1]) if "/ids/" in self.path else max(schemas_)
            self.answer({"id": n, "schema": schemas_[n]})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "auth").write_text("  user:word \n")
    conf = {"schema.registry.url": f"http://127.0.0.1:{server.server_port}/", "schema.registry.options.request.header.X-Team": "data"}
    r = registries.client(Config({**conf, "schema.registry.basic.auth.user.info.file": f"{tmp_path}/auth"}))
    assert r.register("t-value", {"type": "string"}) == 1 and r.by_id(1) == {"type": "string"} and r.latest("t-value") == (1, {"type": "string"})
    token = registries.client(Config({**conf, "schema.registry.options.bearer.auth.token": "abc"}))
    token.register("t-value", "int")
    assert seen == [("/subjects/t-value/versions", "Basic dXNlcjp3b3Jk", "data"), ("/subjects/t-value/versions", "Bearer abc", "data")]
    (tmp_path / "empty").write_text("\n")
    with pytest.raises(ValueError):
        registries.client(Config({**conf, "schema.registry.basic.auth.user.info.file": f"{tmp_path}/empty"}))
    server.shutdown()


class Loud(schemas.Converter):
    """A plug-in: every required field becomes nullable."""

    name = "loud"

    def to_spark(self, schema):
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in schemas.to_spark(schema)])


def test_converter_plug_in(spark, tmp_path):
    conf = Config({"schema.registry.url": f"file:{tmp_path}", "topic": "t", "schema.converter": f"{__name__}.Loud"})
    df = spark.createDataFrame([(1,)], T.StructType([T.StructField("id", T.IntegerType(), False)]))
    sent = avro.AvroEncoder.from_config(conf, registry.Context()).transform(df)
    out = avro.AvroDecoder.from_config(conf, registry.Context()).transform(sent)
    assert out.schema["id"].nullable and out.first().id == 1
    with pytest.raises(TypeError):
        schemas.converter("decimal.Decimal")
    with pytest.raises(ValueError):
        schemas.converter("nowhere")


def test_scaffold_makes_components_that_run(spark, tmp_path, monkeypatch):
    from tributary.plans.scaffold import scaffold

    root = scaffold(str(tmp_path), "my_parts")
    monkeypatch.syspath_prepend(str(root))
    conf = Config.from_file(str(root / "my_parts.properties"))
    conf = Config({**conf, "writer.my_parts.folder": f"{tmp_path}/out", "writer.common.checkpoint.location": f"{tmp_path}/cp"})
    pipeline.run(spark, conf)
    assert spark.read.parquet(f"{tmp_path}/out").columns == ["timestamp", "value", "added"]
    assert {"MyPartsReader", "MyPartsTransformer", "MyPartsWriter"} <= {c.__name__ for c in registry.discover([str(root / "my_parts")]).values()}
    for bad in ("no-name", "class"):
        with pytest.raises(ValueError):
            scaffold(str(tmp_path), bad)
    with pytest.raises(ValueError):
        scaffold(str(tmp_path), "my_parts")
