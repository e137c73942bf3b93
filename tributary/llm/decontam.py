"""Benchmark decontamination by template canonicalisation. DataFrame operations only.

A text becomes a sequence of lower-cased words in which numbers, names and units are *slots*: typed placeholders with
the value kept beside them. Windows of ``window`` template words are hashed and joined with the benchmark's windows; a
document and an item whose matched windows cover enough of the item are a candidate. Its slots are then compared: each
value of the item must stand for one value of the document and the reverse, so a question with new numbers is caught
while a mere likeness of form, whose slots don't map, is not. The mapping must hold over all matched windows or within one
alignment of item and document that covers enough of the item by itself.

Placeholders (typed control characters): \\u0002 a number, \\u0001 a run of capitalised words, \\u0004 a unit after a number. Whether the word that
opens a sentence is a name can't be told from its capital, so every text is read twice and like readings are compared: in
the first such words are literal, in the second any capitalised word is a name. A pair found by either reading counts (the
first is reported where both find it). A window is matched as a template if at least half of its words are literal, in the
second reading ``OPENED`` of them at least, so that a short item is no pattern that any sentence fits. Other windows
(sums, tables, lists of numbers) are matched with their slot values, so a verbatim copy is found. A long quote counts whatever
share of its item it is: ``min_run`` words with their values, in one alignment. Items shorter than the window are
one window of their own length. Defined results: null and empty texts match nothing; repeated rows give the pair once per
id; a null id never matches; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import gathered, maybe_broadcast, read_table, removed, scratch_dir, written

# Units that follow a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches feet foot meter meters metre metres kilometer kilometers mg g kg lb lbs "
    "oz ton tons gram grams kilogram kilograms pound pounds ml l liter liters litre litres s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years mph kmh dollar dollars euro euros cent cents usd "
    "eur percent degrees"
).split()
#: Least literal words of a window in the second reading.
OPENED = 3
NUMBER = r"\d+(?:[.,:/]\d+)*"


NAME = r"(\p{Lu}\p{Ll}+)(?: (\p{Lu}\p{Ll}+))?(?: (\p{Lu}\p{Ll}+))?(?![\p{L}\p{N}])"
#: What must stand before a name, by reading.
BEFORE = (r"(?=\p{Lu})(?<=[\p{Ll},;] )", r"(?=\p{Lu})(?<![\p{L}\p{N}])")


def marked(text: Column) -> Column:
    """The text with numbers and their units marked, for both readings: other signs are blanks, or \u0005 where a name can't
    follow them in the first reading."""
    t = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    # Each pattern tests one character first: looking behind at every position takes many times as long.
    t = F.regexp_replace(t, rf"(?=\d)(?<![\p{{L}}\p{{N}}])({NUMBER})(?: ?(%|(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])))?(?![\p{{L}}\p{{N}}])", " \u0002$1 \u0004$2 ")
    # Blanks stay as they are, so that only other signs are replaced.
    return F.regexp_replace(t, r"(?![ a-zA-Z0-9])(?:[^ \p{L}\p{N}\u0002\u0004%.,:/;]+|[.:/]+(?!\d)|(?<!\d)[.:/]+|(?<!\u0004)%|\u0004(?= ))", " \u0005 ")


def template(text: Column, opening: bool = False) -> Column:
    """Array of words; a slot is its placeholder followed by the value (12, mary\\u0003smith, km).
    ``opening``: capitalised words that open a sentence are names too."""
    return _words(marked(text), opening)


def _words(t: Column, opening: bool) -> Column:
    t = F.regexp_replace(t, BEFORE[opening] + NAME, " \u0001$1\u0003$2\u0003$3 ")
    t = F.regexp_replace(t, r"[;\u0005]|,(?!\d)|,(?<!\d,)", " ")
    return F.array_remove(F.split(F.lower(t), " "), "")


def is_slot(word: Column) -> Column:
    return word < "0"


def _readings(rows: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(``name``, reading r, words w), two rows for each text that has an id."""
    rows = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(name), marked(F.col(text_col)).alias("t"))
    both = F.array(*(F.struct(F.lit(r).alias("r"), _words(F.col("t"), r == 1).alias("w")) for r in (0, 1)))
    return rows.select(name, F.inline(both))


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` (with r, w and a window length len of at most ``window``) with pos, hash h and ``literal`` of each window:
    whether it has enough literal words to be hashed as a template; the hash of others includes the slot values."""
    n = F.size("w")
    # Positions are exploded and their words picked one by one: lambdas and slices of arrays take several times as long.
    at = rows.select("*", F.explode(F.when(n >= F.col("len"), F.sequence(F.lit(1), n - F.col("len") + 1))).alias("pos"))
    words = [F.when(F.col("len") > i, F.get("w", F.col("pos") + (i - 1))) for i in range(window)]
    count = F.lit(0)
    for word in words:
        count = count + F.when(~is_slot(word), 1).otherwise(0)
    literal = (count * 2 >= F.col("len")) & ((F.col("r") == 0) | (count >= OPENED))
    at = at.withColumn("literal", literal)
    signs = [F.when(F.col("literal") & is_slot(word), F.substring(word, 1, 1)).otherwise(word) for word in words]
    return at.withColumn("h", F.xxhash64("r", "len", "literal", *signs))


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    window: int = 8, min_cover: float = 0.5, min_run: int = 50,
) -> DataFrame:
    """(doc id, item id, matched, windows, cover, slots, consistent) of each contaminated pair.

    ``windows``: windows of the item; ``matched``: those found in the document; ``cover``: their share among all windows
    or among those matched as templates, whichever is larger; ``slots``: distinct slot values of the item in those
    of its templates that matched. Only pairs with ``cover >= min_cover`` and consistent slots (or that cover by windows
    matched with their values alone), or with a quote of ``min_run`` words, are returned.
    """
    quote = max(1, min_run - window + 1)  # windows in it
    spark, path = docs.sparkSession, scratch_dir(docs.sparkSession)
    its = _readings(items, item_col, text_col, "item").withColumn("len", F.least(F.size("w"), F.lit(window))).where("len > 0")
    bench = _windows(its, window).select(
        "item", "r", "len", "h", "literal", F.col("pos").alias("item_pos"), F.slice("w", F.col("pos"), F.col("len")).alias("item_words"))
    bench = written(gathered(bench.distinct()), f"{path}/bench")
    lengths = [r[0] for r in bench.select("len").distinct().collect()] or [window]  # at most ``window`` values
    hashes = maybe_broadcast(written(gathered(bench.select("h").distinct()), f"{path}/hashes"))

    def exploded(d: DataFrame) -> DataFrame:
        lens = F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths)))
        return _windows(_readings(d, id_col, text_col, "id").withColumn("len", lens), window)

    # Every window of every document meets the benchmark's distinct hashes; only hits go on.
    hits = written(exploded(docs).select("id", "h").join(hashes, "h", "left_semi").distinct().transform(gathered), f"{path}/hits")
    sizes = bench.groupBy("item", "r").agg(
        F.countDistinct("h").alias("windows"), F.countDistinct(F.when(F.col("literal"), F.col("h"))).alias("templates"))
    # New values change every window that is matched with them, so the templates also count by themselves.
    cover = lambda n, alike: F.greatest(n / F.col("windows"), F.when(F.col("templates") > 0, alike / F.col("templates")))
    pairs = hits.join(maybe_broadcast(bench.select("item", "r", "h", "literal").distinct()), "h").groupBy("id", "item", "r").agg(
        F.count("*").alias("matched"), F.count_if("literal").alias("alike"))
    pairs = pairs.join(sizes, ["item", "r"]).withColumn("cover", cover(F.col("matched"), F.col("alike")))
    pairs = pairs.where((F.col("cover") >= min_cover) | (F.col("matched") >= quote))
    pairs = written(gathered(pairs), f"{path}/pairs")
    removed(spark, f"{path}/hits")
    # Slots and quotes: only documents of a candidate pair whose item has slots, or of little cover, are read again.
    slotted = bench.where(F.col("literal") & F.exists("item_words", lambda w: w.rlike("^[\u0001\u0002\u0004]"))).select("item", "r", F.lit(True).alias("slotted")).distinct()
    look = pairs.join(slotted, ["item", "r"], "left").where(F.col("slotted") | (F.col("cover") < min_cover))
    look = written(gathered(look.select("id", "item", "r")), f"{path}/look")
    again = docs.join(maybe_broadcast(look.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi")
    whole = bench.join(look.select("item", "r").distinct(), ["item", "r"], "left_semi").select("item", "r", "h", "literal", "item_pos", "item_words")
    # The words of a window are cut out before the joins, so no row carries a whole text.
    met = exploded(again).select("id", "h", "pos", F.slice("w", F.col("pos"), F.col("len")).alias("words"))
    found = met.join(maybe_broadcast(whole), "h").join(look, ["id", "item", "r"], "left_semi")
    cells = F.filter(F.arrays_zip(F.col("item_words").alias("a"), F.col("words").alias("b")), lambda z: z["a"].rlike("^[\u0001\u0002\u0004]"))
    cells = F.when(F.col("literal"), cells)  # windows matched with their values agree by themselves
    # One alignment of item and document holds at most one row for each window of the item.
    aligned = found.groupBy("id", "item", "r", (F.col("pos") - F.col("item_pos")).alias("at")).agg(
        F.size(F.collect_set("h")).alias("here"), F.size(F.collect_set(F.when(F.col("literal"), F.col("h")))).alias("alike"),
        F.size(F.collect_set(F.when(F.col("item_words") == F.col("words"), F.col("h")))).alias("same"),
        F.array_distinct(F.flatten(F.collect_list(cells))).alias("cells"))
    aligned = written(gathered(aligned), f"{path}/aligned")
    slot = aligned.select("id", "item", "r", F.explode("cells").alias("z")).select("id", "item", "r", "z.a", "z.b").distinct()
    firm = slot.groupBy("id", "item", "r").agg(
        F.countDistinct("a").alias("slots"), F.count("*").alias("links"), F.countDistinct("b").alias("values"))
    # A document may hold several variants of an item, whose slots clash with one another: one consistent copy is enough.
    distinct = lambda name: F.size(F.array_distinct(F.transform("cells", lambda z: z[name])))
    copies = aligned.join(sizes, ["item", "r"]).where(cover(F.col("here"), F.col("alike")) >= min_cover)
    copies = copies.where((F.size("cells") == distinct("a")) & (F.size("cells") == distinct("b")))
    copies = copies.select("id", "item", "r", F.lit(True).alias("copy")).distinct()
    quotes = aligned.where(F.col("same") >= quote).select("id", "item", "r", F.lit(True).alias("quote")).distinct()
    out = pairs.join(firm, ["id", "item", "r"], "left").join(copies, ["id", "item", "r"], "left").join(quotes, ["id", "item", "r"], "left").withColumn("slots", F.coalesce("slots", F.lit(0).cast("long")))
    # One value of the document for each of the item, and the reverse: as many links as values on both sides.
    one_to_one = (F.col("links") == F.col("slots")) & (F.col("links") == F.col("values"))
    by_value = F.col("matched") - F.col("alike") >= F.col("windows") * min_cover
    mapped = (F.col("slots") == 0) | by_value | one_to_one | F.coalesce("copy", F.lit(False))
    out = out.withColumn("consistent", ((F.col("cover") >= min_cover) & mapped) | F.coalesce("quote", F.lit(False)))
    # One row for a pair: of its first reading that was accepted.
    shown = F.struct("r", "matched", "windows", "cover", "slots", "consistent")
    out = out.where("consistent").groupBy("id", "item").agg(F.min(shown).alias("x"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "x.matched", "x.windows", "x.cover", "x.slots", "x.consistent")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
