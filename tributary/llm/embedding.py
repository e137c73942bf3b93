"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors collapse to one representative with its number of copies. The second-moment matrix of all unit vectors
(summed in the executors) gives a rotation that puts the directions of most energy first. Tiles come from median splits
along the leading directions; a pair of tiles whose bounding boxes are too far apart is skipped. In a pair of tiles the
leading dimensions are multiplied first, and a pair of vectors is dropped as soon as its partial product plus the product
of its residual norms cannot reach the threshold; survivors are completed, and those within 1e-9 of the threshold are
decided by the plain formula in double precision on the original components. Every vector is compared, none sampled:
only the split positions come from a bounded sample (``SPLIT_ROWS`` vectors, or 16 a tile), and they affect speed alone.

A task holds one block of a tile and streams its partners; links are counted there and only a spanning forest of them
leaves it, so a group of near copies never becomes all of its pairs. Tiles hold about ``TILE`` vectors up to ``MAX_TILES`` of
them, which bounds what the driver holds (their boxes, the pairs of tiles that are near); boxes are compared by groups first.
A tile of more than two times ``TILE`` vectors is dealt by hash over several blocks, each a task's home of its own, so a task's
memory doesn't grow with the input; beyond ``MAX_TILES * TILE`` vectors the work of near tiles grows with their square.

Vectors of every dimension are compared, each dimension by itself (cosine is defined between equal dimensions only).
Components are scaled by a power of two where their squares would over- or underflow, which is exact.

Defined results: null or zero vectors and those with null or non-finite components link with nothing, nor do vectors of
different dimensions; a null id is returned with no links and a null component; repeated rows count as vectors; extra
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import connected_components, maybe_broadcast, read_table, removed, scratch_dir, written

TILE, MAX_TILES, SPLIT_ROWS = 4096, 32_768, 20_000
#: Leading dimensions of the tiles' boxes.
BOX = 8


def _dense(col: pa.Array) -> np.ndarray:
    """Binary column of equally long vectors as a matrix."""
    return np.stack([np.frombuffer(b.as_py(), np.float64) for b in col]) if len(col) else np.empty((0, 0))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _dense(batch.column(0))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        d = len(total)
        r, c = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total.ravel())], names=["r", "c", "v"])


def _splits(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Median splits as nodes (dimension, value, left, right); a negative child -k-1 is leaf k."""
    nodes: list[tuple[int, float, int, int]] = []
    count = [0]

    def grow(part: np.ndarray, want: int) -> int:
        if want <= 1 or len(part) < 2:
            count[0] += 1
            return -count[0]
        dim = int(np.argmax(part.max(0) - part.min(0)))
        at = float(np.median(part[:, dim]))
        left = part[:, dim] < at
        if not left.any() or left.all():
            count[0] += 1
            return -count[0]
        k = len(nodes)
        nodes.append((dim, at, 0, 0))
        a, b = grow(part[left], want // 2), grow(part[~left], want - want // 2)
        nodes[k] = (dim, at, a, b)
        return k

    grow(x, leaves)
    return nodes


def _leaf_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    if not nodes:
        return out
    stack = [(0, np.arange(len(x)))]
    while stack:
        k, rows = stack.pop()
        dim, at, a, b = nodes[k]
        left = x[rows, dim] < at
        for child, part in ((a, rows[left]), (b, rows[~left])):
            if child < 0:
                out[part] = -child - 1
            else:
                stack.append((child, part))
    return out


class Forest:
    """Union-find over local numbers that remembers the links it used."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def grow(self, n: int) -> np.ndarray:
        a = len(self.parent)
        self.parent += range(a, a + n)
        return np.arange(a, a + n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def steps_of(values: np.ndarray) -> tuple[int, int]:
    """Numbers of leading dimensions after which at most 45 % and 20 % of the energy (largest values first) is left."""
    left = 1 - np.cumsum(values) / values.sum()
    return tuple(int(np.argmax(left <= x)) + 1 for x in (0.45, 0.2))


def linked_pairs(a: tuple, b: tuple, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the pairs that may reach ``least``. Each side: rotated unit vectors, their leading dimensions and
    residual norm in single precision, and the two dimension counts with the second residual norm.

    Single precision only drops pairs, and with a slack far above its error; what is kept is computed in double."""
    (ya, lead_a, tail_a, tail2_a, steps), (yb, lead_b, tail_b, tail2_b, _) = a, b
    s = lead_a @ lead_b.T
    s += tail_a[:, None] * tail_b
    i, j = np.nonzero(s >= np.float32(least - 1e-4))
    s, done = np.zeros(len(i)), 0
    for end, tails in ((steps[1], True), (ya.shape[1], False)):
        if end > done and len(i):
            part = np.empty(len(i))
            for at in range(0, len(i), 1 << 16):
                w = slice(at, at + (1 << 16))
                part[w] = np.einsum("ij,ij->i", ya[i[w], done:end], yb[j[w], done:end])
            s, done = s + part, end
            ok = s + (tail2_a[i] * tail2_b[j] if tails else 0.0) >= least
            i, j, s = i[ok], j[ok], s[ok]
    return i, j, s


def _compare(rotation: np.ndarray, threshold: float, steps: tuple[int, int]):
    def prepared(x: np.ndarray) -> tuple:
        y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation
        tail = [np.sqrt((y[:, k:] ** 2).sum(1)) for k in steps]
        return y, np.ascontiguousarray(y[:, : steps[0]], np.float32), tail[0].astype(np.float32), tail[1], steps

    def part(side: tuple, w: slice) -> tuple:
        return (*(x[w] for x in side[:4]), steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (home, partner first?): the home tile, then its partners. Yields link counts and forest links."""
        home, own, state = None, [], None

        def settle():
            ids = np.concatenate([o[0] for o in own])
            copies = np.concatenate([o[1] for o in own])
            raw = np.concatenate([o[2] for o in own])
            f = Forest()
            return ids, copies, raw, prepared(raw), f, f.grow(len(ids))

        def against(st, ids, copies, raw, side, nodes, same: bool) -> Iterator[pa.RecordBatch]:
            a_ids, a_copies, a_raw, a_side, f, a_nodes = st
            count_a, count_b = np.zeros(len(a_ids), np.int64), np.zeros(len(ids), np.int64)
            ea, eb = [], []
            for at in range(0, len(a_ids), 256):
                i, j, s = linked_pairs(part(a_side, slice(at, at + 256)), part(side, slice(at if same else 0, None)), threshold - 1e-9)
                i, j = i + at, j + (at if same else 0)
                if same:
                    up = j > i
                    i, j, s = i[up], j[up], s[up]
                near = np.abs(s - threshold) <= 1e-9
                if near.any():
                    p, q = a_raw[i[near]], raw[j[near]]
                    s[near] = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
                ok = s >= threshold
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                count_a += np.bincount(i, copies[j], len(a_ids)).astype(np.int64)
                count_b += np.bincount(j, a_copies[i], len(ids)).astype(np.int64)
                # The first partner of each row, then whatever still joins two components.
                first = np.unique(np.concatenate([np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]]))
                while len(first):
                    for k in first:
                        if f.union(int(a_nodes[i[k]]), int(nodes[j[k]])):
                            ea.append(a_ids[i[k]])
                            eb.append(ids[j[k]])
                    root = {int(n): f.find(int(n)) for n in set(a_nodes[i].tolist()) | set(nodes[j].tolist())}
                    ra = np.array([root[n] for n in a_nodes[i].tolist()]) if len(root) < len(i) else np.fromiter((root[n] for n in a_nodes[i].tolist()), np.int64, len(i))
                    rb = np.fromiter((root[n] for n in nodes[j].tolist()), np.int64, len(j))
                    open_ = np.nonzero(ra != rb)[0]
                    first = open_[np.unique(ra[open_] * (len(f.parent) + 1) + rb[open_], return_index=True)[1]] if len(open_) else open_
            out_ids, out_n = [a_ids[count_a > 0], ids[count_b > 0]], [count_a[count_a > 0], count_b[count_b > 0]]
            n = sum(map(len, out_ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([*out_ids, np.array(ea, np.int64)])), pa.array(np.concatenate([np.zeros(n, np.int64), np.array(eb, np.int64)])),
                 pa.array(np.concatenate([*out_n, np.zeros(len(ea), np.int64)]))], names=["a", "b", "links"])

        for batch in batches:
            homes, tiles = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, copies, raw = batch.column(2).to_numpy(), batch.column(3).to_numpy(), _dense(batch.column(4))
            cuts = np.nonzero(np.diff(homes) | np.diff((homes == tiles).astype(np.int32)))[0] + 1
            for w in np.split(np.arange(len(homes)), cuts):
                if not len(w):
                    continue
                if homes[w[0]] != home:
                    if own and state is None:  # a home without partners
                        st = settle()
                        yield from against(st, *st[:4], st[5], True)
                    home, own, state = homes[w[0]], [], None
                if tiles[w[0]] == home:
                    own.append((ids[w], copies[w], raw[w]))
                    continue
                if state is None:
                    state = settle()
                    yield from against(state, *state[:4], state[5], True)
                yield from against(state, ids[w], copies[w], raw[w], prepared(raw[w]), state[4].grow(len(w)), False)
                # A partner is met once in a home: its nodes can go. Roots are the smallest nodes, so those of the home.
                del state[4].parent[len(state[0]) :]
        if own and state is None:
            st = settle()
            yield from against(st, *st[:4], st[5], True)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, copies, array) to (rep, copies, bytes), components of extreme size scaled by a power of two."""
    for b in batches:
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        if b.num_rows:
            power = np.frexp(np.abs(x).max(1))[1]
            x = np.ldexp(x, np.where(np.abs(power) > 300, -power, 0)[:, None])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["rep", "copies", "vec"])


def near_boxes(los: np.ndarray, his: np.ndarray, reach: float, group: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i <= j, of the boxes within a squared distance; boxes of neighbouring numbers are compared as one first."""
    def close(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(a[:, None] - d, c - b[:, None]))
        return (gap * gap).sum(2) <= reach

    at = np.arange(0, len(los), group)
    low, high = np.minimum.reduceat(los, at), np.maximum.reduceat(his, at)
    out = []
    for x in range(len(at)):
        for y in x + np.nonzero(close(low[x : x + 1], high[x : x + 1], low[x:], high[x:])[0])[0]:
            v, w = slice(at[x], at[x] + group), slice(at[y], at[y] + group)
            i, j = np.nonzero(close(los[v], his[v], los[w], his[w]))
            keep = i + at[x] <= j + at[y]
            out.append((i[keep] + at[x], j[keep] + at[y]))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _linked(classes: DataFrame, d: int, threshold: float, tile: int, path: str) -> DataFrame:
    """(a, b, links) of the distinct vectors of one dimension: forest links (links 0) and link counts (b 0)."""
    spark, n = classes.sparkSession, classes.count()
    packed = written(classes.select("rep", "copies", "v").mapInArrow(_packed, "rep long, copies long, vec binary"), f"{path}/packed")
    sums = packed.select("vec").mapInArrow(_moments, "r int, c int, v double").groupBy("r", "c").agg(F.sum("v")).collect()  # dimension squared
    m = np.zeros((d, d))
    for r, c, x in sums:
        m[r, c] = x
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    rotation = np.ascontiguousarray(vectors[:, np.argsort(-values)])
    lead = min(d, BOX)
    leaves = int(min(MAX_TILES, max(1, -(-n // tile))))

    def leading(vectors_: pa.Array) -> np.ndarray:
        x = _dense(vectors_)
        return np.ascontiguousarray(((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation)[:, :lead])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in leading(b.column(0))], pa.binary())], names=["lead"])

    nodes: list[tuple[int, float, int, int]] = []
    if leaves > 1:
        some = packed.orderBy(F.xxhash64("rep")).limit(max(SPLIT_ROWS, 16 * leaves)).select("vec").mapInArrow(projected, "lead binary").collect()
        nodes = _splits(np.stack([np.frombuffer(r[0], np.float64) for r in some]), leaves)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = leading(b.column(2))
            flat = pa.array(y.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(_leaf_of(y, nodes)), *b.columns, pa.ListArray.from_arrays(np.arange(0, y.size + 1, lead, dtype=np.int32), flat)], names=["leaf", "rep", "copies", "vec", "lead"])

    tiles = written(packed.mapInArrow(placed, "leaf int, rep long, copies long, vec binary, lead array<double>"), f"{path}/tiles")
    ends = [f(F.get("lead", F.lit(k))).alias(f"{s}{k}") for k in range(lead) for f, s in ((F.min, "lo"), (F.max, "hi"))]
    boxes = tiles.groupBy("leaf").agg(F.count("*").alias("n"), *ends).orderBy("leaf").collect()  # one row for each tile
    los = np.array([[r[f"lo{k}"] for k in range(lead)] for r in boxes])
    his = np.array([[r[f"hi{k}"] for k in range(lead)] for r in boxes])
    # Squared distance of unit vectors at the threshold. Each pair of tiles once, dealt evenly around the circle of tiles.
    i, j = near_boxes(los, his, 2 - 2 * threshold + 1e-9)
    far = 2 * (j - i) > len(boxes)
    i, j = np.where(far, j, i), np.where(far, i, j)
    names, blocks = np.array([r["leaf"] for r in boxes], np.int64), np.array([-(-r["n"] // (2 * tile)) for r in boxes], np.int64)
    table = pa.table({"leaf": names[j], "home": names[i], "own": blocks[j], "others": blocks[i]})
    pairs = maybe_broadcast(written(spark.createDataFrame(table), f"{path}/pairs"))
    # Blocks of one tile meet once (a block goes to the homes up to its own), those of two tiles all.
    block = F.pmod(F.xxhash64(F.lit(3), "rep"), "own")
    upto = F.when(F.col("home") == F.col("leaf"), F.col("block")).otherwise(F.col("others") - 1)
    number = lambda leaf, block: F.shiftleft(F.col(leaf).cast("long"), 40) + F.col(block)
    work = tiles.join(pairs, "leaf").withColumn("block", block).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), upto)))
    work = work.select(number("home", "to").alias("home"), number("leaf", "block").alias("tile"), "rep", "copies", "vec")
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "home").sortWithinPartitions("home", F.col("tile") != F.col("home"), "tile")
    found = written(work.mapInArrow(_compare(rotation, threshold, steps_of(np.sort(values)[::-1])), "a long, b long, links long"), f"{path}/found")
    for name in ("packed", "tiles", "pairs"):
        removed(spark, f"{path}/{name}")
    return found


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    v = F.col(vec_col).cast("array<double>")
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))  # NaN is greatest
    fine = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull()) & (most > 0) & (most < float("inf"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumns({"f1": F.xxhash64("v"), "f2": F.xxhash64(F.lit(7), "v")})
    good = rows.where("fine")
    classes = good.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = written(classes.withColumn("d", F.size("v")), f"{path}/classes")
    found = spark.createDataFrame([], "a long, b long, links long")
    for d in sorted(r[0] for r in classes.select("d").distinct().collect()):  # one run for each dimension that occurs
        found = found.unionByName(_linked(classes.where(F.col("d") == d), d, threshold, tile, f"{path}/{d}"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("links = 0").select("a", "b"), f"{path}/components").withColumnRenamed("node", "rep")
    # What holds for a class is joined per class; the rows then join it once, in a join that adaptive execution can split.
    known = classes.select("f1", "f2", "rep", "copies").join(counts, "rep", "left").join(comps, "rep", "left")
    known = written(known.select("f1", "f2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), f"{path}/known")
    out = rows.select("id", "fine", "f1", "f2").join(known, ["f1", "f2"], "left")
    comp = F.coalesce(F.when(F.col("fine"), F.col("component")), F.col("id"))
    links = F.when(F.col("fine"), F.col("links")).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), comp.alias("component_id"), (F.col("id") == comp).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_sum(list_transform(e, lambda x: x * x)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id LEFT JOIN c ON c.x = v.vec_id
"""
