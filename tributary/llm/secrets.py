"""Secret scan with grammar inference.

Base patterns give labelled credentials. For each kind a probabilistic automaton is inferred from a bounded sample of
them: a prefix tree of character classes whose states are merged while a Hoeffding test finds their stop and transition
frequencies compatible. The sample is of at most ``SAMPLE`` distinct values a kind, spread over all lengths and skeletons
(signs kept, letters and digits alike), so that rare formats are in it. Ordinary text is an automaton too, whose states are the
last two character classes; its frequencies are counted over every token of every document, and once more without the tokens
that already look likelier as credentials, so that many bare credentials don't pass as what is ordinary. Every token of at least
``MIN_TOKEN`` characters outside the base spans is then scored: it is a secret when the log-likelihood ratio favours a
credential's format by ``margin`` and its likelihood per character and its length are typical of that kind. The method only
adds spans; base spans stay as they are. No credential is written anywhere but into the result.

Offsets are code points, ends exclusive; spans are whole matches. Defined results: null and empty texts have no spans;
repeated rows are scanned each; a null id is kept, ids are of any type; without labelled credentials no automaton adds
spans; of formats that score alike the first kind is named; extra columns are ignored; very long texts are read whole; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import read_table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: As short as the shortest credential of the base patterns.
MIN_TOKEN = 8
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_TOKEN},}}")
SAMPLE, ALPHA, SMALL = 1000, 0.05, 8


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A maximal run of 32 or more is what the open pattern finds and keeps.
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, token) of the long tokens that no base span overlaps; full stops at the ends are not part of one."""
    out, k = [], 0
    ends = list(accumulate((e for _, _, e, _ in taken), max))  # spans are sorted by start; the furthest end so far
    for m in TOKEN.finditer(text):
        value = m[0].strip(".")
        if len(value) < MIN_TOKEN:
            continue
        a = m.start() + len(m[0]) - len(m[0].lstrip("."))
        while k < len(taken) and taken[k][0] < a + len(value):
            k += 1
        if k == 0 or ends[k - 1] <= a:
            out.append((a, value))
    return out


#: Character classes, then the start (twice before a token) and the end.
SYMBOLS = "9hlHU+/_.=-^$"
SIZE = {"9": 10, "h": 6, "l": 20, "H": 6, "U": 20}


def symbol(c: str) -> str:
    return "9" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if c.islower() else "H" if "A" <= c <= "F" else "U" if c.isupper() else c


CLASS = {ord(c): symbol(c) for c in string.ascii_letters + string.digits}
#: The number of a byte's class in SYMBOLS.
NUMBER = np.array([max(0, SYMBOLS.find(CLASS.get(i, chr(i)))) for i in range(256)], np.int64)


def classes(value: str) -> str:
    return value.translate(CLASS)


def triples(tokens: list[str]) -> np.ndarray:
    """How often each symbol follows each two; one count for every triple of ``SYMBOLS``."""
    n = NUMBER[np.frombuffer("".join(f"^^{t}$" for t in tokens).encode(), np.uint8)]
    k = len(SYMBOLS)
    seen = np.bincount((n[:-2] * k + n[1:-1]) * k + n[2:], minlength=k**3).reshape(k, k, k) if len(n) else np.zeros((k, k, k), np.int64)
    seen[:, :, SYMBOLS.index("^")] = 0  # from one token into the next
    return seen


class Ordinary:
    """What ordinary tokens look like: an automaton whose states are the last two classes, from all tokens' counts."""

    def __init__(self, seen: np.ndarray):
        p = np.log((seen + 0.1) / (seen + 0.1).sum(2, keepdims=True))
        p -= np.log([SIZE.get(c, 1) for c in SYMBOLS])
        self.step = {a + b + c: float(p[i, j, k]) for i, a in enumerate(SYMBOLS) for j, b in enumerate(SYMBOLS) for k, c in enumerate(SYMBOLS)}

    def log_likelihood(self, value: str) -> float:
        c = f"^^{classes(value)}$"
        return sum(self.step[c[i : i + 3]] for i in range(len(c) - 2))


class Automaton:
    """Probabilistic deterministic automaton inferred by merging compatible prefix-tree states."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.stop, self.go = [0], [{}]  # per state: times it ended; symbol -> [state, times]
        for v in values:
            s = 0
            for c in classes(v):
                if c not in self.go[s]:
                    self.go[s][c] = [len(self.go), 0]
                    self.stop.append(0)
                    self.go.append({})
                self.go[s][c][1] += 1
                s = self.go[s][c][0]
            self.stop[s] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, s: int) -> int:
        return self.stop[s] + sum(n for _, n in self.go[s].values())

    def _apart(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            na, nb = self._total(a), self._total(b)
            if min(na, nb) < SMALL:
                continue
            if self._apart(self.stop[a], na, self.stop[b], nb):
                return False
            for c in self.go[a].keys() | self.go[b].keys():
                if self._apart(self.go[a].get(c, (0, 0))[1], na, self.go[b].get(c, (0, 0))[1], nb):
                    return False
                if c in self.go[a] and c in self.go[b] and self.go[a][c][0] != self.go[b][c][0]:
                    stack.append((self.go[a][c][0], self.go[b][c][0]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree under ``blue`` to ``red``."""
        stack = [(red, blue)]
        while stack:
            a, b = stack.pop()
            self.stop[a] += self.stop[b]
            for c, (to, n) in self.go[b].items():
                if c in self.go[a]:
                    self.go[a][c][1] += n
                    stack.append((self.go[a][c][0], to))
                else:
                    self.go[a][c] = [to, n]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            reds = set(red)
            blue = next(((s, c, t[0]) for s in red for c, t in sorted(self.go[s].items()) if t[0] not in reds), None)
            if blue is None:
                break
            s, c, b = blue
            to = next((r for r in red if self._compatible(r, b)), None)
            if to is None:
                red.append(b)
            else:
                self.go[s][c][0] = to
                self._fold(to, b)
        self.red = red

    def log_likelihood(self, value: str) -> float:
        """Natural logarithm of the probability of the value's format and characters; smoothed for unseen steps."""
        s, out = 0, 0.0
        for c in classes(value):
            n = self._total(s)
            to, k = self.go[s].get(c, (0, 0))
            out += math.log((k + 0.01) / (n + 0.1)) - math.log(SIZE.get(c, 1))
            s = to
        return out + math.log((self.stop[s] + 0.01) / (self._total(s) + 0.1))


class Format:
    """An automaton with what is typical of the values it was inferred from."""

    def __init__(self, values: list[str]):
        self.automaton = Automaton(values)
        scores = sorted(self.automaton.log_likelihood(v) / (len(v) + 1) for v in values)
        self.low, self.high = scores[len(scores) // 50] - 0.05, scores[-1 - len(scores) // 50] + 0.05
        self.least, self.most = 0.75 * min(map(len, values)), 1.5 * max(map(len, values))

    def fits(self, value: str, ordinary: float) -> float:
        """How much likelier than as an ordinary token; 0 if it isn't typical of the format."""
        if not self.least <= len(value) <= self.most:
            return 0.0
        own = self.automaton.log_likelihood(value)
        return own - ordinary if self.low <= own / (len(value) + 1) <= self.high else 0.0


LEARNT = pa.schema([("kind", pa.int32()), ("part", pa.string()), ("hash", pa.int64()), ("value", pa.string()), ("n", pa.int64())])
#: Values of one length and skeleton that a sample may hold.
SPREAD = 64


class Verdicts(dict):
    """The kind (as a number, or -1) of each token; a cache of bounded size, emptied when full."""

    def __init__(self, formats: dict[str, Format], ordinary: Ordinary, margin: float):
        self.formats, self.ordinary, self.margin, self.held = [(KINDS.index(k), f) for k, f in formats.items()], ordinary, margin, 0

    def __missing__(self, value: str) -> int:
        fit = [(k, f) for k, f in self.formats if f.least <= len(value) <= f.most]
        plain = self.ordinary.log_likelihood(value) if fit else 0.0
        gain, kind = max(((f.fits(value, plain), -k) for k, f in fit), default=(0.0, 0))
        out = -kind if gain > self.margin else -1
        self.held += len(value)
        if self.held > 8_000_000:
            self.clear()
            self.held = len(value)
        self[value] = out
        return out


def counts(tokens: list[str]) -> list[tuple]:
    seen = triples(tokens).ravel()
    return [(-1, str(i), 0, "", int(seen[i])) for i in np.flatnonzero(seen)]


def learnt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(LEARNT)], schema=LEARNT)


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to labelled credentials, each in its part (length, skeleton, one of ``SPREAD``), and to counts of triples (kind -1)."""
    for batch in batches:
        values, tokens = set(), []
        for text in batch.column(0):
            t = text.as_py() or ""
            spans = base_spans(t)
            values |= {(k, v) for _, k, _, v in spans}
            tokens += [v for _, v in candidates(t, spans)]
        out = counts(tokens)
        for k, v in values:
            h = xxhash.xxh64_intdigest(v) >> 1
            out.append((k, f"{len(v)}:{re.sub('[A-Za-z0-9]+', 'a', v)}:{h % SPREAD}", h, v, 1))
        yield learnt(out)


def _plain(formats: dict[str, Format], ordinary: Ordinary):
    """Texts to counts of triples without tokens that are likelier as credentials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdicts = Verdicts(formats, ordinary, 0.0)
        for batch in batches:
            tokens = [v for text in batch.column(0) for t in [text.as_py() or ""] for _, v in candidates(t, base_spans(t)) if verdicts[v] < 0]
            yield learnt(counts(tokens))

    return run


def infer_formats(texts: DataFrame) -> tuple[dict[str, Format], Ordinary]:
    """A format for each kind of which there are credentials, and the automaton of ordinary tokens."""
    kind = "kind int, part string, hash long, value string, n long"

    def total(rows: DataFrame) -> Ordinary:
        seen = np.zeros(len(SYMBOLS) ** 3, np.int64)
        for r in rows.where("kind = -1").groupBy("part").agg(F.sum("n").alias("n")).collect():  # at most a row for each triple
            seen[int(r[0])] = r[1]
        return Ordinary(seen.reshape([len(SYMBOLS)] * 3))

    rows = texts.mapInArrow(_learnt, kind)
    first = rows.groupBy("kind", "part").agg(F.min(F.struct("hash", "value")).alias("x"), F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    formats = {}
    for k, name in enumerate(KINDS):
        # The remainder of the hash is the round: one value of every length and skeleton, then the next.
        some = first.where(F.col("kind") == k).orderBy(F.pmod("x.hash", F.lit(SPREAD)), "x").select("x.value").limit(SAMPLE).collect()
        if some:
            formats[name] = Format([r[0] for r in some])
    ordinary = total(first)
    first.unpersist()
    return formats, total(texts.mapInArrow(_plain(formats, ordinary), kind)) if formats else ordinary


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = 8.0) -> DataFrame:
    """(id, spans) of each row; ``spans``: array of (start, kind, stop, value), kind a base kind or ``auto_`` and one."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    formats, ordinary = infer_formats(rows.select("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, verdicts = [*KINDS, *(f"auto_{k}" for k in KINDS)], Verdicts(formats, ordinary, margin)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("stop", pa.int64()), ("value", pa.string())]))
        for batch in batches:
            out = []
            for text in batch.column(0):
                t = text.as_py() or ""
                spans = base_spans(t)
                added = [(a, 3 + k, a + len(v), v) for a, v in candidates(t, spans) for k in [verdicts[v]] if k >= 0] if formats else []
                out.append([{"start": a, "kind": names[k], "stop": b, "value": v} for a, k, b, v in sorted(spans + added)])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, kind)], names=["id", "spans"])

    kind = T.StructType([rows.schema["id"]]).add("spans", T.ArrayType(T.StructType.fromDDL("start long, kind string, stop long, value string")))
    return rows.mapInArrow(judge, kind).withColumnRenamed("id", id_col)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*KINDS))
    n = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))
