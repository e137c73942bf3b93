"""Surrogates for personal data.

Entities are found by pattern, normalised (so that mentions in other case or punctuation corefer) and replaced by keyed
surrogates of their own type and format. Two ways make surrogates distinct:

* Formatted values (mail and network addresses, card, account, security and phone numbers) go through a keyed permutation
  of the space of their own format: letters stay letters of the same script and case, digits digits, mail addresses keep
  their top-level domain and shape, card numbers their check-digit validity, account numbers (IBAN) country and a valid
  check, address octets their range and width, phone numbers their country code. A permutation is one to one however much
  of a format's space is in use, and this one is a single cycle, so no value stands for itself. In a nearly full space
  (addresses of four single digits) a surrogate can be another document's real value; it then stands for that document's
  value only by chance, and the mapping stays one to one.
* A person's name (each word of it is an entity: script and name) becomes a made-up name of the same script, and of the
  gender that its titles say. The gender is settled once for the corpus: that of all titles next to the name, neutral
  where they differ or where only surnames' positions are seen. The names of the corpus are tabled and checked: a surrogate
  whose visible form two names share, or that is a real name, is drawn again, a syllable longer, until none clashes.

A name that a title introduces is also replaced where the same document repeats it without a title. Names that no title
introduces anywhere in a document are not detected; letters of scripts other than Latin, Cyrillic, Greek and Han stay as they are
inside addresses.

Defined results: null text stays null with no entities; repeated rows are treated alike; a null id is kept, ids are of any
type; a text without entities is unchanged; very long texts are read whole; other columns are not returned; an empty
table gives an empty table. Equal key and corpus give equal surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import maybe_broadcast, read_table, scratch_dir, written

# Honorifics by gender, and syllables that surrogate names are built from, by script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Don"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña"),
    "n": ("Dr", "Prof", "Mx"),
}
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi".split(), {"m": "n r s k".split(), "f": "a ia na la".split(), "n": "el in is".split()}),
    "cyrillic": ("ба ве га до ка ле ли ма ми на не ни па ра ре ри са се та те ти".split(), {"m": "н р с к".split(), "f": "а на ла".split(), "n": "ин ис".split()}),
    "greek": ("βα γα δε κα λε λι μα μι να νε νι πα ρα ρε ρι σα τα τε".split(), {"m": "ος ης".split(), "f": "α η".split(), "n": "ι".split()}),
}
_NAME = r"[^\W\d_a-zà-ÿа-яα-ω][^\W\d_]+"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])\w[\w.+-]*@[^\W_][\w-]*(?:\.[^\W_][\w-]*)*\.[^\W\d_]{2,}")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![\w:])")),
    ("phone", re.compile(r"(?<![\w+./-])0\d{1,4}[ /-]\d{4,9}(?![\w-])|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?\d[\d .-]{6,12}\d(?!\w)")),
    ("person", re.compile(rf"\b({'|'.join(t for ts in TITLES.values() for t in ts)})\b\.? ({_NAME})(?: ({_NAME}))?")),
)
GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: Kinds that hold a digit.
NUMBERED = {"iban", "card", "ssn", "ip", "ipv6", "phone"}


def find(text: str) -> tuple[list[tuple[int, int, str, str]], dict[str, str]]:
    """(start, end, type, normal form) of the entities, leftmost first, where an earlier type wins an overlap; and of each
    name the genders that its titles say (any of m, f)."""
    out: list[tuple[int, int, str, str]] = []
    genders: dict[str, set[str]] = {}
    digits, at = any(c in text for c in "0123456789"), "@" in text
    taken = bytearray(len(text)) if digits or at else b""

    def add(a: int, b: int, kind: str, norm: str) -> None:
        nonlocal taken
        if not taken:
            taken = bytearray(len(text))
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind, norm))

    for kind, pattern in PATTERNS:
        if kind == "email" and not at or kind in NUMBERED and not digits:
            continue
        for m in pattern.finditer(text):
            if kind != "person":
                add(m.start(), m.end(), kind, normal(kind, m[0]))
                continue
            for g in (2, 3):
                if m[g]:
                    name = f"{script(m[g])}:{m[g].lower()}"
                    add(m.start(g), m.end(g), kind, name)
                    said = GENDER[m[1]] if g == 2 else "n"  # a first name's; the last of several names is a family's
                    genders.setdefault(name, set()).update({said} - {"n"})
    if genders:  # the same names elsewhere in the document
        forms = {f for n in genders for w in [n.split(":", 1)[1]] for f in (w.capitalize(), w.upper())}
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, forms), key=len, reverse=True))})(?!\w)", text):
            add(m.start(), m.end(), "person", f"{script(m[0])}:{m[0].lower()}")
    return sorted(out), {n: "".join(sorted(g)) for n, g in genders.items()}


def normal(kind: str, said: str) -> str:
    if kind in ("email", "ip", "ipv6"):
        return said.lower()
    return "".join(c for c in said.upper() if c.isalnum() or c == "+")


def script(name: str) -> str:
    c = name[0].lower()
    return "cyrillic" if "а" <= c <= "ӿ" else "greek" if "α" <= c <= "ϗ" else "latin"


def luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


class Permutation:
    """A keyed permutation of 0..n-1 that is one cycle: x goes to P'(P(x) + step), P a Feistel network walked inside n."""

    ROUNDS = 8

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.half = n, max(1, ((n - 1).bit_length() + 1) // 2)
        self.key = hmac.new(key, f"{label}\0{n}".encode(), hashlib.sha256).digest()
        self.mask, self.size = (1 << self.half) - 1, (self.half + 7) // 8
        self.step = 1 + self._round(99, 0) % (n - 1) if n > 1 else 0

    def _round(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.shake_256(self.key + bytes([i]) + x.to_bytes(self.size, "big")).digest(self.size), "big") & self.mask

    def _walk(self, x: int, rounds: range) -> int:
        while True:
            a, b = x >> self.half, x & self.mask
            for i in rounds:
                a, b = b, a ^ self._round(i, b)
            x = b << self.half | a  # halves swapped, so the rounds in reverse order undo it
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        y = (self._walk(x, range(self.ROUNDS)) + self.step) % self.n
        return self._walk(y, range(self.ROUNDS - 1, -1, -1))


#: Letters that stand for one another, by script; the Latin letters with marks are a class of their own.
ALPHABETS = [("0", 10), ("a", 26), ("A", 26), ("à", 23), ("ø", 7), ("а", 32), ("α", 17), ("σ", 7), ("\u4e00", 20_000)]


def places(c: str, hexadecimal: bool = False) -> tuple[str, int] | None:
    """First sign and size of the alphabet that a sign is replaced within; None: it stays."""
    if hexadecimal:
        return ("0123456789abcdef", 16) if c in "0123456789abcdef" else None
    return next(((first, n) for first, n in ALPHABETS if ord(first) <= ord(c) < ord(first) + n), None)


def permuted(key: bytes, kind: str, said: str, hexadecimal: bool = False) -> str:
    """A value moved within the space of its own format: signs without an alphabet stay where they are."""
    cells = [places(c, hexadecimal) for c in said]
    x, n = 0, 1
    for c, cell in zip(said, cells, strict=True):
        if cell:
            x, n = x * cell[1] + (int(c, 16) if hexadecimal else ord(c) - ord(cell[0])), n * cell[1]
    shape = "".join(cell[0][0] if cell else c for c, cell in zip(said, cells, strict=True))
    y, out = Permutation(key, f"{kind}\0{shape}", n)(x), []
    for c, cell in zip(reversed(said), reversed(cells), strict=True):
        if cell:
            y, d = divmod(y, cell[1])
            c = "0123456789abcdef"[d] if hexadecimal else chr(ord(cell[0]) + d)
        out.append(c)
    return "".join(reversed(out))


def surrogate_value(key: bytes, kind: str, norm: str) -> str:
    """Normal form of a formatted value's replacement; one to one among the values of a kind."""
    if kind == "email":
        head, _, tld = norm.rpartition(".")
        return permuted(key, kind, head) + "." + tld
    if kind == "ipv6":
        return permuted(key, kind, norm, True)
    if kind == "ip":
        # Octets by width: 0-9, 10-99 (or 0 and a digit), 100-255.
        spans = [(0, 10, 1) if len(o) == 1 else (100, 156, 3) if len(o) == 3 else (0, 10, 2) if o[0] == "0" else (10, 90, 2) for o in norm.split(".")]
        x, n = 0, 1
        for o, (low, size, _) in zip(norm.split("."), spans, strict=True):
            x, n = x * size + int(o) - low, n * size
        y, out = Permutation(key, f"ip\0{spans}", n)(x), []
        for low, size, width in reversed(spans):
            y, d = divmod(y, size)
            out.append(f"{low + d:0{width}d}")
        return ".".join(reversed(out))
    if kind == "card":
        # The check digit is written as its distance from the valid one, and a distance of 0 stays 0.
        off = luhn([int(c) for c in norm])
        if off:
            body, off = divmod(Permutation(key, "card", 9 * 10 ** (len(norm) - 1))(int(norm[:-1]) * 9 + off - 1), 9)
            off, rest = off + 1, f"{body:0{len(norm) - 1}d}"
        else:
            rest = permuted(key, "card\0valid", norm[:-1])
        return rest + str((off - luhn([int(c) for c in rest + "0"])) % 10)
    if kind == "iban":
        rest = permuted(key, f"iban\0{norm[:2]}", norm[4:])
        number = "".join(str(int(c, 36)) for c in rest + norm[:2] + "00")
        return f"{norm[:2]}{98 - int(number) % 97:02d}{rest}"
    if kind == "phone":
        code = norm[: len(norm) - 10] if norm.startswith("+") and len(norm) > 11 else norm[:3] if norm.startswith("+") else norm[:1] if norm.startswith("0") else ""
        return code + permuted(key, f"phone\0{code}", norm[len(code) :])
    return permuted(key, kind, norm)


def surrogate_name(key: bytes, name: str, gender: str, attempt: int = 0) -> str:
    """A made-up name (lower case) for ``script:name``; every further attempt is a syllable longer."""
    heads, tails = SYLLABLES[name.split(":", 1)[0]]
    draw = int.from_bytes(hmac.new(key, f"person\0{name}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha512).digest(), "big")
    out = ""
    for _ in range(max(2, min(5, (len(name) - name.index(":")) // 2)) + attempt):
        draw, at = divmod(draw, len(heads))
        out += heads[at]
    return out + tails[gender][draw % len(tails[gender])]


def dressed(said: str, new: str) -> str:
    """The replacement in the mention's own format: its case and its separators."""
    if len(new) == len(said):
        return "".join(n.upper() if s.isupper() else n for s, n in zip(said, new, strict=True))
    letters = iter(new)
    return "".join(next(letters) if c.isalnum() or c == "+" else c for c in said)


def dressed_name(said: str, new: str) -> str:
    return new.upper() if said.isupper() and len(said) > 1 else new.capitalize()


SEEN = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("found", pa.list_(pa.struct([("name", pa.string()), ("said", pa.string())])))])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t1, t2, text) to the names of each text that has some, with what their titles say."""
    for b in batches:
        out = []
        for t1, t2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            names = find(text.as_py() or "")[1]
            if names:
                out.append((t1, t2, [{"name": n, "said": g} for n, g in sorted(names.items())]))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], SEEN.field(i).type) for i in range(3)], schema=SEEN)


def _drawn(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(3)]
            new = [surrogate_name(key, *x) for x in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=["name", "gender", "attempt", "new"])

    return run


def settle(names: DataFrame, key: bytes, path: str, most: int = 40) -> DataFrame:
    """(name, gender, attempt, new) of each distinct (name, gender), such that no two share ``new`` and none is a real name."""
    kind = "name string, gender string, attempt int, new string"
    settled = written(names.select("name", "gender", F.lit(0).alias("attempt")).mapInArrow(_drawn(key), kind), f"{path}/drawn0")
    real = settled.select(F.substring_index("name", ":", -1).alias("new")).distinct()
    for k in range(1, most):
        # Of those that share a visible name the least (attempt, name) keeps it; one that is a real name is kept by none.
        first = settled.groupBy("new").agg(F.min(F.struct("attempt", "name")).alias("keep"), F.count("*").alias("n")).where("n > 1")
        clash = settled.join(first, "new").where(F.struct("attempt", "name") != F.col("keep")).select("name")
        again = written(clash.unionAll(settled.join(real, "new", "left_semi").select("name")).distinct(), f"{path}/again{k}")
        if again.isEmpty():
            return settled
        redo = settled.join(again, "name", "left_semi").select("name", "gender", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_drawn(key), kind)
        settled = written(settled.join(again, "name", "left_anti").unionAll(redo), f"{path}/drawn{k}")
    raise RuntimeError("surrogates did not settle")


class Values(dict):
    """Surrogates of formatted values; a bounded cache, emptied when full."""

    def __init__(self, key: bytes):
        self.key = key

    def __missing__(self, at: tuple[str, str]) -> str:
        if len(self) > 50_000:
            self.clear()
        new = self[at] = surrogate_value(self.key, *at)
        return new


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(key)
        for b in batches:
            texts, counts = [], []
            for text, known in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                t = text.as_py()
                names = {k["name"]: k["new"] for k in known or ()}
                parts, at, got = [], 0, find(t)[0] if t else []
                for a, e, k, n in got:
                    parts += [t[at:a], dressed_name(t[a:e], names[n]) if k == "person" else dressed(t[a:e], values[k, n])]
                    at = e
                texts.append("".join([*parts, t[at:]]) if got else t)
                counts.append(len(got))
            rest = [b.column(i) for i in range(2, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["id", "text", "n_entities"])

    return run


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities) of each row, with surrogates for the entities."""
    path = scratch_dir(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))
    # Names are a property of the text alone; equal texts give equal rows here, which are joined back once.
    seen = rows.select("t1", "t2", "text").mapInArrow(_names, "t1 long, t2 long, found array<struct<name:string,said:string>>")
    each = written(seen.select("t1", "t2", F.inline("found")).distinct(), f"{path}/seen")
    m, f = (F.max(F.contains("said", F.lit(x))) for x in "mf")
    gender = F.when(m & ~f, "m").when(f & ~m, "f").otherwise("n")
    names = settle(each.groupBy("name").agg(gender.alias("gender")), key, path).select("name", "new")
    known = each.select("t1", "t2", "name").join(maybe_broadcast(names), "name").groupBy("t1", "t2").agg(F.collect_list(F.struct("name", "new")).alias("known"))
    known = maybe_broadcast(written(known, f"{path}/known"))
    out = rows.join(known, ["t1", "t2"], "left").select("text", "known", "id").mapInArrow(_replace(key), rows.select("id", "text", F.lit(0).cast("long").alias("n_entities")).schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_entities")


#: Of the tests and the registered query; a deployment passes its own.
DEMO_KEY = b"demonstration key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read_table(spark, sf_dir, "documents"), DEMO_KEY)
