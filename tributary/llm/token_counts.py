"""Token counts under a unigram vocabulary, by Viterbi without building the pieces.

An Aho-Corasick automaton lists every vocabulary match in a word, ordered by end and, for one end, longest first. Dynamic
programming keeps for each position the best score and the number of pieces on its path. The tie rules are those of the
``tokenizers`` library's Unigram model: a later candidate replaces a kept one only with a strictly higher score, a
character that is no piece of its own costs the least score less ten, and neighbouring unknown characters are one piece.
Words are cut at Unicode white space and begin with U+2581. No tokenizer is trained: pieces and their order come from a
public vocabulary file, and the score of the piece of rank r is -log(r + 1).

The dynamic programme keeps no more positions than the longest piece has, so a word of any length takes bounded memory,
and counts of short words are kept in a cache of a bounded number of characters.

Defined results: null and empty texts count 0; repeated rows count each; a null id is kept, ids are of any type; extra
columns are ignored; very long texts and words are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.common import read_table

MODEL, MARK, UNKNOWN_COST = "piece_bpe_32k.model", "▁", 10.0
#: A mark in the text begins a part of its own.
PARTS = re.compile("\u2581[^\u2581]*")
#: str.split also cuts at these, which are not white space in Unicode.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


@lru_cache(2)
def vocabulary(model: str = MODEL) -> tuple[tuple[str, float], ...]:
    """(piece, score) of the unknown piece and the ordinary pieces of a vocabulary file."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return (("<unk>", 0.0), *((sp.id_to_piece(i), -math.log(r + 1)) for r, i in enumerate(ids, 1)))


class Counter(dict):
    """Number of pieces of each word; a cache of at most ``most`` characters (and 64 more a word), emptied when full."""

    def __init__(self, vocab: tuple[tuple[str, float], ...], most: int = 40_000_000, longest: int = 1000):
        super().__init__()
        self.most, self.longest, self.held, self.machine = most, longest, 0, ahocorasick.Automaton()
        for piece, score in vocab[1:]:
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.width = 1 + max(len(piece) for piece, _ in vocab)
        self.unknown = min(s for _, s in vocab) - UNKNOWN_COST

    def __missing__(self, word: str) -> int:
        whole = word if word.startswith(MARK) else MARK + word
        n = sum(self.pieces(m[0]) for m in PARTS.finditer(whole)) if MARK in word else self.pieces(whole)
        if len(word) <= self.longest:
            self.held += len(word) + 64
            if self.held > self.most:
                self.clear()
                self.held = len(word) + 64
            self[word] = n
        return n

    def pieces(self, word: str) -> int:
        n, at = len(word), 0
        w = min(n + 1, self.width + 1)  # positions are kept in a ring
        best, count, unknown = [0.0] * w, [0] * w, [False] * w
        found, single = False, False

        def closed(end: int) -> None:
            """The unknown candidate of a position comes last: it starts latest."""
            if not single:
                s, e = (end - 1) % w, end % w
                score = best[s] + self.unknown
                if not found or score > best[e]:
                    count[e] = count[s] + (not unknown[s])
                    best[e], unknown[e] = score, True

        for end, (length, score) in self.machine.iter(word):
            end += 1
            while at < end - 1:
                at += 1
                closed(at)
                found = single = False
            s, e = (end - length) % w, end % w
            score += best[s]
            if not found or score > best[e]:
                best[e], count[e], unknown[e], found = score, count[s] + 1, False, True
            if length == 1:
                single = True
        while at < n:
            at += 1
            closed(at)
            found = single = False
        return count[n % w]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [w for w in SPACE.split(text) if w] if NOT_SPACE.search(text) else text.split()


@lru_cache(2)
def counter(model: str = MODEL) -> Counter:
    return Counter(vocabulary(model))


def _count(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model)
        for batch in batches:
            counts = [sum(map(of.__getitem__, words_of(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_tokens) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_count(model), kind).withColumnRenamed("id", id_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
