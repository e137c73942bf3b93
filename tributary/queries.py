"""Registered queries of the ingestion operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import fs
from tributary.config import Config
from tributary.functions import avro_schema, schema_registry
from tributary.operators import avro, cdc, columns, dedup
from tributary.plans import pipeline
from tributary.sources import checkpoint, topic
from tributary.sources.readers import KafkaReader, ParquetReader
from tributary.streaming.cdc import HistoryWriter, SnapshotWriter
from tributary.streaming.sinks import DocumentWriter, KafkaWriter, ParquetWriter
from tributary.streaming.store import VersionedTable

ONCE = {"once": True}
OPS = ("view", "click", "signup", "purchase", "error")
HISTORY = cdc.Merge("user_id", "event_type", ("error",), ("event_type", "event_id"), {"event_type": OPS}, "day")
SNAPSHOT = cdc.Merge("user_id", "event_type", ("error",), ("day", "event_type"), {"event_type": OPS})


#: Avro types by field name; expected Spark types are in the SQL.
AVRO_TYPES = (
    ("a_boolean", "boolean"), ("a_int", "int"), ("a_long", "long"), ("a_float", "float"), ("a_double", "double"), ("a_string", "string"), ("a_bytes", "bytes"),
    ("an_enum", {"type": "enum", "name": "e", "symbols": ["A", "B"]}), ("a_fixed", {"type": "fixed", "name": "f", "size": 3}),
    ("a_date", {"type": "int", "logicalType": "date"}), ("millis", {"type": "long", "logicalType": "timestamp-millis"}), ("micros", {"type": "long", "logicalType": "timestamp-micros"}),
    ("a_decimal", {"type": "bytes", "logicalType": "decimal", "precision": 8, "scale": 3}),
    ("a_fixed_decimal", {"type": "fixed", "name": "g", "size": 5, "logicalType": "decimal", "precision": 10, "scale": 2}),
    ("an_array", {"type": "array", "items": ["null", "double"]}), ("a_map", {"type": "map", "values": "int"}),
    ("a_record", {"type": "record", "name": "inner", "fields": [{"name": "x", "type": ["null", "string"]}]}),
    ("nullable", ["null", "string"]), ("int_or_long", ["int", "long"]), ("float_or_double", ["null", "float", "double"]), ("a_union", ["null", "boolean", "int", "double"]),
)


def work(spark: SparkSession) -> str:
    """A new folder for sinks, checkpoints, topics and registries: in the shared checkpoint folder, which only a local master
    may leave unset. With its scheme, which registries, topics and document sinks go by."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{fs.qualified(spark, base or 'file:///tmp/checkpoints').rstrip('/')}/{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str, steps=(), partition_by: list[str] | None = None) -> str:
    """Stream a table through transformers into Parquet; the destination."""
    d = work(spark)
    q = pipeline.start(spark, ParquetReader(f"{sf_dir}/{name}*.parquet"), list(steps), ParquetWriter(f"{d}/out", ONCE, f"{d}/checkpoint", partition_by))
    pipeline.finish(q)
    return f"{d}/out"


def parquet_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [columns.ColumnSelector(["event_id", "user_id", "event_type", "value"]), columns.ColumnRenamer(["value"], ["amount"])]
    return spark.read.parquet(streamed(spark, sf_dir, "events", steps))


def parquet_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(streamed(spark, sf_dir, "lineitem", [], ["l_returnflag", "l_linestatus"]))
    return out.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def select_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.ColumnSelector(["*"]).transform(table(spark, sf_dir, "nation"))


def select_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.ColumnSelector(["c_custkey", "c_mktsegment"]).transform(table(spark, sf_dir, "customer"))


def rename_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.ColumnRenamer(["s_name", "label", "absent"], ["label", "title", "x"]).transform(table(spark, sf_dir, "supplier"))


def copy_nested_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = ["info.name", "info.money.balance", "info.`the.key`", "info.name"]
    df = columns.ColumnCopier(["c_name", "c_acctbal", "c_custkey", "c_nationkey"], to).transform(table(spark, sf_dir, "customer"))
    return df.select("c_custkey", F.col("info.money.balance").alias("balance"), F.col("info.`the.key`").alias("the_key"), F.col("info.name").alias("nation"))


def _versions(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    d = work(spark)
    for _ in range(times):
        table(spark, sf_dir, "region").write.mode("append").parquet(f"{d}/in")
        step = columns.AddDateVersion("2024-02-29", f"{d}/out")
        q = pipeline.start(spark, ParquetReader(f"{d}/in"), [step], ParquetWriter(f"{d}/out", ONCE, f"{d}/checkpoint", ["ingest_date", "ingest_version"]))
        pipeline.finish(q)
    added = [F.col("ingest_date").cast("string").alias("ingest_date"), F.col("ingest_version").cast("int").alias("ingest_version")]
    return spark.read.parquet(f"{d}/out").select("r_regionkey", "r_name", *added)


def date_version_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir, 1)


def date_version_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir, 2)


def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = columns.AddAuditColumns("2024-02-29").transform(table(spark, sf_dir, "part"))
    return df.select("p_partkey", F.size("errCol").cast("long").alias("n_errors"), F.col("info_date").cast("string").alias("info_date"), "info_date_string", "info_version")


def sort_rank_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cdc.with_sort_columns(table(spark, sf_dir, "events"), "rank_", ["event_type"], {"event_type": OPS[:3]})
    return df.select("event_id", F.col("rank_event_type").cast("long").alias("rank"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))


def batches(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    e = days(spark, sf_dir)
    return [e.where(F.col("event_id") % n == k) for k in range(n)]


def _cdc(spark: SparkSession, sf_dir: str, writer: type, merge: cdc.Merge, parts: list[DataFrame]) -> DataFrame:
    t = VersionedTable(spark, f"{work(spark)}/table")
    w = writer(t.path, ONCE, "memory", merge)
    for k, b in enumerate(parts):
        w.table(b)
        t.merge(b, w.merged, "q", k)
    return t.read()


INTERVAL = ("CAST(_start_date AS string) AS start_date", "CAST(_end_date AS string) AS end_date", "_is_current AS is_current")


def _history(df: DataFrame) -> DataFrame:
    return df.selectExpr("user_id", "event_id", "event_type", *INTERVAL)


def snapshot_one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdc(spark, sf_dir, SnapshotWriter, SNAPSHOT, [days(spark, sf_dir)]).select("user_id", "event_id")


def snapshot_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cdc(spark, sf_dir, SnapshotWriter, SNAPSHOT, batches(spark, sf_dir, 2)).select("user_id", "event_id")


def scd2_one_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(_cdc(spark, sf_dir, HistoryWriter, HISTORY, [days(spark, sf_dir)]))


def scd2_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(_cdc(spark, sf_dir, HistoryWriter, HISTORY, batches(spark, sf_dir, 2)))


def scd2_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = batches(spark, sf_dir, 2)
    return _history(_cdc(spark, sf_dir, HistoryWriter, HISTORY, [a, b, a, b]))


def scd2_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history through the streaming writer, on orders: natural (key, timestamp) conflicts."""
    d = work(spark)
    m = cdc.Merge("o_custkey", "o_orderstatus", ("P",), ("o_orderstatus", "o_orderkey"), {"o_orderstatus": ("O", "F", "P")}, "o_orderdate")
    q = pipeline.start(spark, ParquetReader(f"{sf_dir}/orders*.parquet"), [], HistoryWriter(f"{d}/table", ONCE, f"{d}/checkpoint", m))
    pipeline.finish(q)
    return VersionedTable(spark, f"{d}/table").read().selectExpr("o_custkey", "o_orderkey", *INTERVAL)


def _registry(spark: SparkSession) -> schema_registry.FileRegistry:
    return schema_registry.client(Config({"schema.registry.url": work(spark)}))


def avro_roundtrip_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, df = _registry(spark), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    sent = avro.AvroEncoder("events", r, Config({})).transform(df)
    return avro.AvroDecoder(r.latest("events-value")[1], r).transform(sent)


def _keyed(spark: SparkSession, sf_dir: str):
    context, r = avro.Context(), _registry(spark)
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key__id"), "o_custkey", "o_orderstatus", "o_totalprice")
    context.put(avro.PREFIX, "key__")
    context.put(avro.NAMES, ["key__id"])
    return avro.AvroEncoder("orders", r, Config({}), True, context).transform(df), r


def avro_roundtrip_keyvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent, r = _keyed(spark, sf_dir)
    return avro.AvroDecoder(r.latest("orders-value")[1], r, r.latest("orders-key")[1]).transform(sent)


def avro_keep_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent, r = _keyed(spark, sf_dir)
    return avro.AvroDecoder(r.latest("orders-value")[1], r, keep=["source"]).transform(sent.withColumn("source", F.lit("orders")))


def topic_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events encoded into a topic, streamed to another topic and decoded."""
    d, r = topic.local_path(work(spark)), _registry(spark)
    for t in ("in", "out"):
        topic.create_topic(d, t, 3)
    topic.register(spark)
    df = table(spark, sf_dir, "nation")
    avro.AvroEncoder("in", r, Config({})).transform(df).write.format("topic").mode("append").option("path", d).option("topic", "in").save()
    reader, writer = KafkaReader("in", f"file:{d}", f"{d}/checkpoint"), KafkaWriter("out", f"file:{d}", f"{d}/checkpoint", ONCE)
    q = pipeline.start(spark, reader, [columns.ColumnSelector(["key", "value"])], writer)
    pipeline.finish(q)
    return avro.AvroDecoder(r.latest("in-value")[1], r).transform(topic.read_batch(spark, f"file:{d}", "out"))


def uncommitted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a partial write left beside a streamed table: how many, and how many the log lists."""
    out = streamed(spark, sf_dir, "region")
    table(spark, sf_dir, "nation").coalesce(1).write.mode("append").parquet(f"{out}/stray=1")
    row = (len(checkpoint.uncommitted_files(spark, out)), len(checkpoint.committed_files(spark, out)) > 0)
    return spark.createDataFrame([row], "strays long, has_log boolean")


def _sent(spark: SparkSession, df: DataFrame, d: str, name: str, registry: schema_registry.FileRegistry) -> None:
    rows = avro.AvroEncoder(name, registry, Config({})).transform(df)
    rows.write.format("topic").mode("append").option("path", d).option("topic", name).save()


def _deduplicated(spark: SparkSession, sf_dir: str, deduplicate: bool) -> DataFrame:
    """Customers through two topics in two batches; the second was written but not committed, and runs again."""
    d, at, r = topic.local_path(work(spark)), work(spark), _registry(spark)
    for t, n in (("in", 3), ("out", 2)):
        topic.create_topic(d, t, n)
    topic.register(spark)
    ids = ["value.c_custkey"]

    def run() -> None:
        schema = r.latest("in-value")[1]
        step = dedup.TopicDeduplicator(("in", f"file:{d}"), ("out", f"file:{d}"), at, ids, ids, r, lambda t, key: schema)
        steps = [avro.AvroDecoder(schema, r), *([step] if deduplicate else []), avro.AvroEncoder("out", r, Config({}))]
        reader, writer = KafkaReader("in", f"file:{d}", at), KafkaWriter("out", f"file:{d}", at, ONCE)
        pipeline.finish(pipeline.start(spark, reader, steps, writer))

    people = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    for part in (people.where("c_custkey % 3 = 0"), people.where("c_custkey % 3 <> 0")):
        _sent(spark, part, d, "in", r)
        run()
    for f in ("1", ".1.crc"):
        fs.delete(spark, f"{at}/commits/{f}")
    run()
    return avro.AvroDecoder(r.latest("out-value")[1], r).transform(topic.read_batch(spark, f"file:{d}", "out"))


def dedup_after_failed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the de-duplicator a batch that runs again adds nothing."""
    return _deduplicated(spark, sf_dir, True)


def retry_without_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without it the records of the batch are written twice: at least once."""
    return _deduplicated(spark, sf_dir, False)


def topic_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest records of each partition between offsets: counts, least and greatest offset by partition."""
    d = topic.local_path(work(spark))
    topic.create_topic(d, "t", 4)
    topic.register(spark)
    keyed = table(spark, sf_dir, "nation").select(F.encode("n_name", "UTF-8").alias("key"), F.encode("n_name", "UTF-8").alias("value"))
    keyed.coalesce(1).write.format("topic").mode("append").option("path", d).option("topic", "t").save()
    ends = topic.end_offsets(d, "t")
    tail = topic.at_least_latest(spark, f"file:{d}", "t", dict.fromkeys(ends, 3), ends)
    got = tail.groupBy("partition").agg(F.count("*").alias("n"), (F.max("offset") - F.min("offset") + 1).alias("span"))
    whole = spark.createDataFrame(list(ends.items()), "partition int, total long")
    fine = (F.col("n") == F.least("total", F.lit(3))) & (F.col("span") == F.col("n"))
    return whole.where("total > 0").join(got, "partition", "left").agg(F.sum("total").alias("records"), F.min(fine).alias("tails_fit"))


def rate_limited_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 records at most 10 a micro-batch, and after a restart."""
    d, at = topic.local_path(work(spark)), work(spark)
    topic.create_topic(d, "in", 3)
    topic.register(spark)
    rows = table(spark, sf_dir, "nation").select(F.encode("n_name", "UTF-8").alias("key"), F.encode("n_name", "UTF-8").alias("value"))
    writer = ParquetWriter(f"{at}/out", {"processingTime": "0 seconds"}, f"{at}/checkpoint")
    for _ in range(2):
        rows.write.format("topic").mode("append").option("path", d).option("topic", "in").save()
        reader = KafkaReader("in", f"file:{d}", f"{at}/checkpoint", {"maxOffsetsPerTrigger": "10"})
        query = pipeline.start(spark, reader, [], writer)
        pipeline.finish(query, "ProcessAllAvailable")
    out = spark.read.parquet(f"{at}/out")
    batches_ = checkpoint.latest_offsets(spark, f"{at}/checkpoint")[0] + 1
    names = out.select(F.decode("value", "UTF-8").alias("n_name")).groupBy("n_name").agg(F.count("*").alias("copies"))
    return names.withColumn("batches", F.lit(batches_).cast("long"))


def null_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a value are dropped; those with one keep their columns."""
    r, df = _registry(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    sent = avro.AvroEncoder("events", r, Config({})).transform(df.where("event_id % 5 <> 0"))
    nulls = df.where("event_id % 5 = 0").select(F.lit(None).cast("binary").alias("value"))
    return avro.AvroDecoder(r.latest("events-value")[1], r).transform(sent.unionByName(nulls))


def naming_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy registers under its own subject, which a decoder finds by the same settings, or by number."""
    out = None
    for k, strategy in enumerate(("topic.name", "record.name", "topic.record.name")):
        at = work(spark)
        own = {"schema.registry.url": at, "topic": "t", "value.schema.naming.strategy": strategy, "value.schema.record.name": "region", "value.schema.record.namespace": "geo"}
        conf = Config(own)
        sent = avro.AvroEncoder.from_config(conf, avro.Context()).transform(table(spark, sf_dir, "region"))
        subject = ("t-value", "geo.region", "t-geo.region")[k]
        number = schema_registry.client(conf).latest(subject)[0]
        for said in ("latest", str(number)):
            step = avro.AvroDecoder.from_config(Config({**own, "value.schema.id": said}), avro.Context())
            part = step.transform(sent).withColumn("subject", F.lit(subject)).withColumn("by_number", F.lit(said != "latest"))
            out = part if out is None else out.unionByName(part)
    return out


def optional_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields made optional in the registered schema, also inside a struct; rows stay as they are."""
    r = _registry(spark)
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.struct("s_name", "s_acctbal").alias("detail"), F.col("s_nationkey").alias("nation"))
    sent = avro.AvroEncoder("s", r, Config({"value.optional.fields": "nation,detail.s_name"})).transform(df)
    schema = r.latest("s-value")[1]
    of = {f["name"]: f for f in schema["fields"]}
    inner = next(b for b in of["detail"]["type"] if isinstance(b, dict)) if isinstance(of["detail"]["type"], list) else of["detail"]["type"]
    name = next(f for f in inner["fields"] if f["name"] == "s_name")
    said = all(f["type"][0] == "null" and "default" in f and f["default"] is None for f in (of["nation"], name))
    out = avro.AvroDecoder(schema, r).transform(sent)
    return out.select("id", "nation", F.col("detail.s_name").alias("s_name"), F.lit(said).alias("optional"))


def avro_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Spark type of every Avro type: primitive, logical, nested, nullable and union."""
    record = {"type": "record", "name": "r", "fields": [{"name": n, "type": t} for n, t in AVRO_TYPES]}
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in avro_schema.to_spark(record)]
    return spark.createDataFrame(rows, "field string, spark_type string, nullable boolean")


def avro_rich_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals, dates, timestamps, binaries, arrays, maps and structs there and back."""
    r, df = _registry(spark), table(spark, sf_dir, "orders")
    df = df.select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_orderdate").cast("timestamp").alias("at"), F.encode("o_orderstatus", "UTF-8").alias("raw"),
        F.array("o_orderstatus", F.lit(None)).alias("list"), F.create_map("o_orderstatus", "o_custkey").alias("map"), F.struct("o_custkey", F.lit(None).cast("int").alias("none")).alias("s"))
    out = _there_and_back(r, df)
    return out.select(
        "o_orderkey", (F.col("price") * 100).cast("long").alias("cents"), F.col("day").cast("string").alias("day"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.decode("raw", "UTF-8").alias("raw"), F.size("list").cast("long").alias("n"), F.col("list")[1].isNull().alias("no_second"),
        F.element_at("map", F.col("list")[0]).alias("mapped"), F.col("s.o_custkey").alias("custkey"), F.col("s.none").isNull().alias("none"))


def _there_and_back(r: schema_registry.FileRegistry, df: DataFrame) -> DataFrame:
    sent = avro.AvroEncoder("o", r, Config({})).transform(df)
    return avro.AvroDecoder(r.latest("o-value")[1], r).transform(sent)


def document_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two micro-batches of documents, the second after a restart; read back from the folder of JSON lines."""
    d = work(spark)
    for part in ("nation", "region"):
        source = table(spark, sf_dir, part).select(F.col(f"{part[0]}_name").alias("name"), F.lit(part).alias("kind"))
        source.write.mode("append").parquet(f"{d}/in")
        writer = DocumentWriter(ONCE, f"{d}/checkpoint", f"{d}/docs", "db", "places")
        pipeline.finish(pipeline.start(spark, ParquetReader(f"{d}/in"), [], writer))
    return spark.read.json(f"{d}/docs/db/places").select("name", "kind", F.col("batch").cast("long").alias("batch"))


def scd2_upsert_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert history writer, composed from configuration, in two batches; the table doesn't exist before the first."""
    d = work(spark)
    own = "writer.hudicdctoscd2"
    conf = Config({
        "component.reader": "parquet-reader", "reader.parquet.source.directory": f"{d}/in", "component.writer": "cdc-scd2-upsert-writer",
        "writer.common.checkpoint.location": f"{d}/checkpoint", f"{own}.destination.directory": f"{d}/table", f"{own}.key.column": "user_id",
        f"{own}.timestamp.column": "day", f"{own}.operation.column": "event_type", f"{own}.operation.deleted.values": "error",
        f"{own}.precombineColumns": "event_type, event_id", f"{own}.precombineColumns.customOrder.event_type": ", ".join(OPS),
    })
    for part in batches(spark, sf_dir, 2):
        part.write.mode("append").parquet(f"{d}/in")
        pipeline.run(spark, conf)
    return _history(VersionedTable(spark, f"{d}/table").read())


def composed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader, transformers in the order of their numbers and writer from dotted configuration."""
    d = work(spark)
    conf = Config.from_lines([
        "component.reader=parquet-reader", f"reader.parquet.source.directory={sf_dir}/customer*.parquet", "component.writer=parquet-writer",
        f"root={d}", "writer.parquet.destination.directory=${root}/out", "writer.common.checkpoint.location=${root}/checkpoint",
        "writer.parquet.partition.columns=segment", "component.transformer.id.2=rename", "component.transformer.id.-1=pick",
        "component.transformer.class.pick=column-selector", "transformer.pick.columns.to.select=c_custkey, c_mktsegment",
        "component.transformer.class.rename=column-renamer", "transformer.rename.columns.rename.from=c_mktsegment", "transformer.rename.columns.rename.to=segment",
        "ingestor.spark.termination.method=AwaitTermination",
    ])
    pipeline.run(spark, conf)
    return spark.read.parquet(f"{d}/out").select("c_custkey", "segment")


QUERIES = (
    parquet_passthrough, parquet_partitioned, select_all, select_subset, rename_chain, copy_nested_flat, date_version_first, date_version_second, audit_columns,
    sort_rank_custom, snapshot_one_batch, snapshot_two_batches, scd2_one_batch, scd2_two_batches, scd2_redelivery, scd2_stream, avro_roundtrip_value,
    avro_roundtrip_keyvalue, avro_keep_columns, topic_passthrough, uncommitted_files, dedup_after_failed_batch, retry_without_dedup, topic_tail,
    rate_limited_topic, null_payloads, naming_strategies, optional_fields, avro_type_map, avro_rich_rows, document_sink, scd2_upsert_writer, composed_pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_OPS = "['view','click','signup','purchase','error']"
_SCD2 = f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY list_position({_OPS}, event_type) DESC, event_id DESC) AS rn
           FROM (SELECT *, date_trunc('day', ts) AS day FROM events)),
     n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM d WHERE rn = 1)
SELECT user_id, event_id, event_type, strftime(day, '%Y-%m-%d %H:%M:%S') AS start_date,
       strftime(CASE WHEN event_type = 'error' THEN day ELSE nxt END, '%Y-%m-%d %H:%M:%S') AS end_date, event_type <> 'error' AND nxt IS NULL AS is_current FROM n
"""
_KEYVALUE = "SELECT o_orderkey AS key__id, o_custkey, o_orderstatus, o_totalprice FROM orders"


def oracle_sql() -> dict[str, str]:
    version = "SELECT r_regionkey, r_name, '2024-02-29' AS ingest_date, {} AS ingest_version FROM region"
    return {
        "parquet_passthrough": "SELECT event_id, user_id, event_type, value AS amount FROM events",
        "parquet_partitioned": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY ALL",
        "select_all": "SELECT * FROM nation",
        "select_subset": "SELECT c_custkey, c_mktsegment FROM customer",
        "rename_chain": "SELECT s_suppkey, s_name AS title, s_nationkey, s_acctbal FROM supplier",
        "copy_nested_flat": "SELECT c_custkey, c_acctbal AS balance, c_custkey AS the_key, c_nationkey AS nation FROM customer",
        "date_version_first": version.format(1),
        "date_version_second": version.format(1) + " UNION ALL " + version.format(2),
        "audit_columns": "SELECT p_partkey, CAST(0 AS BIGINT) AS n_errors, '2024-02-29' AS info_date, '2024-02-29' AS info_date_string, 1 AS info_version FROM part",
        "sort_rank_custom": "SELECT event_id, CAST(coalesce(list_position(['view','click','signup'], event_type), 0) AS BIGINT) AS rank FROM events",
        "snapshot_one_batch": f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, list_position({_OPS}, event_type) DESC, event_id DESC) AS rn FROM events)
SELECT user_id, event_id FROM l WHERE rn = 1 AND event_type <> 'error'""",
        "snapshot_two_batches": f"""
WITH e AS (SELECT user_id, event_id, event_type, date_trunc('day', ts) AS d, list_position({_OPS}, event_type) AS rk FROM events),
     l AS (SELECT *, event_id % 2 AS b, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY d DESC, rk DESC, event_id DESC) AS rn FROM e),
     cur AS (SELECT * FROM l WHERE b = 0 AND rn = 1 AND event_type <> 'error'), chg AS (SELECT * FROM l WHERE b = 1 AND rn = 1),
     j AS (SELECT c.user_id AS ck, n.user_id AS nk, n.event_type = 'error' AS del, (n.d > c.d) OR (n.rk > c.rk) AS upd, c.event_id AS ce, n.event_id AS ne
           FROM cur c FULL JOIN chg n ON c.user_id = n.user_id)
SELECT coalesce(ck, nk) AS user_id, CASE WHEN ck IS NULL OR upd THEN ne ELSE ce END AS event_id FROM j WHERE nk IS NULL OR NOT del""",
        "scd2_one_batch": _SCD2,
        "scd2_two_batches": _SCD2,
        "scd2_redelivery": _SCD2,
        "scd2_stream": """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY list_position(['O','F','P'], o_orderstatus) DESC, o_orderkey DESC) AS rn FROM orders),
     n AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS nxt FROM d WHERE rn = 1)
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_date,
       strftime(CASE WHEN o_orderstatus = 'P' THEN o_orderdate ELSE nxt END, '%Y-%m-%d %H:%M:%S') AS end_date, o_orderstatus <> 'P' AND nxt IS NULL AS is_current FROM n""",
        "avro_roundtrip_value": "SELECT event_id, user_id, event_type, value FROM events",
        "avro_roundtrip_keyvalue": _KEYVALUE,
        "avro_keep_columns": "SELECT 'orders' AS source, o_custkey, o_orderstatus, o_totalprice FROM orders",
        "topic_passthrough": "SELECT * FROM nation",
        "dedup_after_failed_batch": "SELECT c_custkey, c_mktsegment FROM customer",
        "retry_without_dedup": "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0",
        "topic_tail": "SELECT count(*) AS records, true AS tails_fit FROM nation",
        "rate_limited_topic": "SELECT n_name, CAST(2 AS BIGINT) AS copies, CAST(6 AS BIGINT) AS batches FROM nation",
        "null_payloads": "SELECT event_id, event_type FROM events WHERE event_id % 5 <> 0",
        "naming_strategies": """
SELECT r.*, s.subject, b.by_number FROM region r, (VALUES ('t-value'), ('geo.region'), ('t-geo.region')) s(subject), (VALUES (true), (false)) b(by_number)""",
        "optional_fields": "SELECT s_suppkey AS id, s_nationkey AS nation, s_name, true AS optional FROM supplier",
        "avro_type_map": """
SELECT * FROM (VALUES ('a_boolean', 'boolean', false), ('a_int', 'int', false), ('a_long', 'bigint', false), ('a_float', 'float', false), ('a_double', 'double', false),
  ('a_string', 'string', false), ('a_bytes', 'binary', false), ('an_enum', 'string', false), ('a_fixed', 'binary', false), ('a_date', 'date', false),
  ('millis', 'timestamp', false), ('micros', 'timestamp', false), ('a_decimal', 'decimal(8,3)', false), ('a_fixed_decimal', 'decimal(10,2)', false),
  ('an_array', 'array<double>', false), ('a_map', 'map<string,int>', false), ('a_record', 'struct<x:string>', false), ('nullable', 'string', true),
  ('int_or_long', 'bigint', false), ('float_or_double', 'double', true), ('a_union', 'struct<member0:boolean,member1:int,member2:double>', true)) t(field, spark_type, nullable)""",
        "avro_rich_rows": """
SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)) * 100) AS BIGINT) AS cents, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at,
       o_orderstatus AS raw, CAST(2 AS BIGINT) AS n, true AS no_second, o_custkey AS mapped, o_custkey AS custkey, true AS none FROM orders""",
        "document_sink": "SELECT n_name AS name, 'nation' AS kind, CAST(0 AS BIGINT) AS batch FROM nation UNION ALL SELECT r_name, 'region', 1 FROM region",
        "scd2_upsert_writer": _SCD2,
        "composed_pipeline": "SELECT c_custkey, c_mktsegment AS segment FROM customer",
        "uncommitted_files": "SELECT CAST(1 AS BIGINT) AS strays, true AS has_log",
    }
