"""A partitioned topic log as a Spark data source (``format("topic")``), with the columns of Spark's Kafka source.

``<path>/<topic>/<partition>/<first offset>.jsonl`` holds append-only segments. Streams track the next offset of each
partition. It stands in for a broker where none can be reached; readers and writers take either.
"""

from __future__ import annotations

import base64
import json
import os
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"


def create_topic(path: str, topic: str, partitions: int = 1) -> None:
    for p in range(partitions):
        (Path(path) / topic / str(p)).mkdir(parents=True, exist_ok=True)


def partitions_of(path: str, topic: str) -> list[int]:
    return sorted(int(p.name) for p in (Path(path) / topic).iterdir() if p.name.isdigit())


def _segments(path: str, topic: str, partition: int) -> list[tuple[int, Path]]:
    return sorted((int(f.stem), f) for f in (Path(path) / topic / str(partition)).glob("*.jsonl"))


def local_path(uri: str) -> str:
    """The folder that a ``file:`` URI names."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def end_offsets(path: str, topic: str) -> dict[int, int]:
    """Next offset of each partition. Segments end with the offset of their last record, so gaps are fine."""
    out = {}
    for p in partitions_of(path, topic):
        segs = _segments(path, topic, p)
        last = 0
        if segs:
            with open(segs[-1][1], "rb") as f:
                last = json.loads(f.read().rstrip().rsplit(b"\n", 1)[-1])["offset"] + 1
        out[p] = last
    return out


def append(path: str, topic: str, partition: int, rows: list[tuple[bytes | None, bytes | None]]) -> None:
    """Append records; the segment appears under its name once it is complete."""
    if not rows:
        return
    first = end_offsets(path, topic)[partition]
    to = Path(path) / topic / str(partition) / f"{first:020d}.jsonl"
    enc = lambda b: None if b is None else base64.b64encode(b).decode()
    side = to.with_suffix(f".{os.getpid()}.tmp")
    now = time.time()
    side.write_text("".join(json.dumps({"offset": first + i, "key": enc(k), "value": enc(v), "ts": now}) + "\n" for i, (k, v) in enumerate(rows)))
    os.link(side, to)  # fails if another writer took the offset
    side.unlink()


class Range(InputPartition):
    def __init__(self, partition: int, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


def _rows(path: str, topic: str, r: Range) -> Iterator[tuple]:
    import datetime

    dec = lambda s: None if s is None else base64.b64decode(s)
    segs = _segments(path, topic, r.partition)
    for i, (first, file) in enumerate(segs):
        if first >= r.end or i + 1 < len(segs) and segs[i + 1][0] <= r.start:
            continue
        with open(file, encoding="utf-8") as f:
            for line in f:
                x = json.loads(line)
                if r.start <= x["offset"] < r.end:
                    yield dec(x["key"]), dec(x["value"]), topic, r.partition, x["offset"], datetime.datetime.fromtimestamp(x["ts"]), 0


def _starting(options: dict, path: str, topic: str) -> dict[int, int]:
    said = options.get("startingoffsets", "earliest")
    ends = end_offsets(path, topic)
    if said == "earliest":
        return dict.fromkeys(ends, 0)
    if said == "latest":
        return ends
    given = json.loads(said)
    given = given.get(topic, given)
    return {p: int(given.get(str(p), 0)) for p in ends}


class TopicReader(DataSourceReader):
    def __init__(self, o: dict):
        self.path, self.topic, self.o = o["path"], o["subscribe"], dict(o)

    def partitions(self) -> list[Range]:
        ends = end_offsets(self.path, self.topic)
        if (said := self.o.get("endingoffsets", "latest")) != "latest":
            given = json.loads(said)
            given = {int(p): int(x) for p, x in given.get(self.topic, given).items()}
            for p, x in given.items():
                if x > ends.get(p, 0):
                    raise ValueError(f"offset {x} of partition {p} is beyond its end {ends.get(p, 0)}")
            ends |= given
        starts = _starting(self.o, self.path, self.topic)
        return [Range(p, starts[p], e) for p, e in ends.items() if e > starts[p]] or [Range(0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.path, self.topic, partition)


def limited(start: dict[int, int], ends: dict[int, int], most: int) -> dict[int, int]:
    """Ends of the next batch of at most ``most`` records, shared out by what each partition has left; the rest of the
    division goes to the partitions of smallest number, so a batch is never empty while there are records."""
    left = {p: max(0, e - start.get(p, 0)) for p, e in ends.items()}
    total = sum(left.values())
    if total <= most:
        return ends
    share = {p: most * n // total for p, n in left.items()}
    spare = most - sum(share.values())
    for p in sorted(left):
        more = min(spare, left[p] - share[p])
        share[p], spare = share[p] + more, spare - more
    return {p: start.get(p, 0) + share[p] for p in ends}


class TopicStreamReader(DataSourceStreamReader):
    """``maxOffsetsPerTrigger`` limits a micro-batch. ``committedOffsets`` tells a restarted query where its checkpoint stands,
    since the engine asks for the next end without saying from where."""

    def __init__(self, o: dict):
        self.path, self.topic, self.o = o["path"], o["subscribe"], dict(o)
        self.at = {int(p): int(x) for p, x in json.loads(o["committedoffsets"]).items()} if o.get("committedoffsets") else None

    def initialOffset(self) -> dict:
        return {str(p): x for p, x in _starting(self.o, self.path, self.topic).items()}

    def latestOffset(self) -> dict:
        ends = end_offsets(self.path, self.topic)
        if most := self.o.get("maxoffsetspertrigger"):
            if int(most) < 1:
                raise ValueError("maxOffsetsPerTrigger must be positive")
            ends = limited(_starting(self.o, self.path, self.topic) if self.at is None else self.at, ends, int(most))
        return {str(p): x for p, x in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = {int(p): int(x) for p, x in end.items()}
        return [Range(int(p), int(start.get(p, 0)), int(e)) for p, e in end.items() if int(e) > int(start.get(p, 0))]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _rows(self.path, self.topic, partition)


class _Write:
    def __init__(self, o: dict):
        self.path, self.topic = o["path"], o["topic"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Records go to the partition of their key's hash; at least once, as a failed batch is written again."""
        import zlib

        n, mine = len(partitions_of(self.path, self.topic)), {}
        for i, r in enumerate(rows):
            d = r.asDict()
            key, value = (None if d.get(c) is None else bytes(d[c]) if not isinstance(d[c], str) else d[c].encode() for c in ("key", "value"))
            mine.setdefault((zlib.crc32(key) if key is not None else i) % n, []).append((key, value))
        for p, got in mine.items():
            for attempt in range(50):
                try:
                    append(self.path, self.topic, p, got)
                    break
                except FileExistsError:
                    time.sleep(0.01 * (attempt + 1))
            else:
                raise OSError(f"partition {p} stayed busy")
        return WriterCommitMessage()


class TopicWriter(_Write, DataSourceWriter):
    pass


class TopicStreamWriter(_Write, DataSourceStreamWriter):
    pass


class TopicSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TopicReader:
        return TopicReader(self.options)

    def streamReader(self, schema) -> TopicStreamReader:
        return TopicStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        return TopicWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicSource)


def read_batch(spark: SparkSession, brokers: str, topic: str, starting: dict[int, int] | str = "earliest", ending: dict[int, int] | str = "latest", **options: str) -> DataFrame:
    """Records between two offset maps, as a batch DataFrame; ``brokers`` ``file:<path>`` is a topic folder."""
    say = lambda x: x if isinstance(x, str) else json.dumps({topic: {str(p): o for p, o in x.items()}})
    r = source(spark, spark.read, brokers).option("subscribe", topic).options(**options)
    return r.option("startingOffsets", say(starting)).option("endingOffsets", say(ending)).load()


def source(spark: SparkSession, r, brokers: str):
    """A reader or writer of ``kafka``, or of ``topic`` where the brokers are ``file:<path>``."""
    if brokers.startswith("file:"):
        register(spark)
        return r.format("topic").option("path", local_path(brokers))
    return r.format("kafka").option("kafka.bootstrap.servers", brokers)


def at_least_latest(spark: SparkSession, brokers: str, topic: str, wanted: dict[int, int], ends: dict[int, int], **options: str) -> DataFrame:
    """At least the ``wanted`` latest records of each partition; lower bounds walk back until offset gaps are made up for."""
    low = {p: max(0, ends[p] - n) for p, n in wanted.items()}
    while True:
        start = {p: low.get(p, e) for p, e in ends.items()}
        df = read_batch(spark, brokers, topic, start, ends, **options)
        have = {r[0]: r[1] for r in df.groupBy("partition").count().collect()}  # a row for each partition
        short = [p for p, n in wanted.items() if low[p] > 0 and have.get(p, 0) < n]
        if not short:
            return df
        for p in short:
            low[p] = max(0, low[p] - wanted[p])
