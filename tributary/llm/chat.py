"""Chat formatting: heterogeneous layouts are recognised by schema fingerprints. DataFrame operations only.

A record's *fingerprint* is the hash of its sorted nested field paths (``a.b``, ``a[].b``). ``LAYOUTS`` are declarative
mappings (a turn array with role and content fields, or single prompt and reply fields), each with the paths it requires and
those it may have. Of a record's paths those that a mapping knows are hashed, and the mapping is selected if it declares
that hash; fields that no mapping knows (ids, names, scores) don't disturb it. The first mapping in order counts, so a new
layout is one entry and no code. Records that none fits are kept with ``turns`` null and their fingerprint, never dropped.

Canonical turns are then laid out by a template. Its control strings all begin with ``<|``; in a text (and a role) every
``<``, ``\\*``, ``|`` run gets one more backslash, which is undone exactly on reading, so no text can forge a turn.

Defined results: null text and role are empty; turns are ordered by (turn, role, text) with null turns first; repeated
rows are turns of their own; rows with a null conversation id form one conversation; extra columns are ignored; an empty
turn array gives no turns and an empty format; an empty table gives an empty table.
Rows that are turns already become their turns directly, by the fingerprint of the table's own columns (``ROWS``).
Foreign records are parsed as a variant: JSON that isn't null and gives none (malformed, over 128 MiB as a variant, or a
string of over 20 million characters) has ``unread`` true and no layout, fingerprint or turns.
One conversation is one output row, so its turns meet in one task: that is the unit of the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import read_table

OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``required`` and ``optional``: field paths that tell the layout. ``array``: path of the turn array with ``role`` and
    ``text`` fields, or none, in which case ``singles`` are (role, path) in order; an absent or empty one is no turn, and
    without a user's turn the first turn, if a system's, is the user's. ``parts``: the text is an array of objects with this field."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    array: str | None = None
    role: str = ""
    text: str = ""
    parts: str | None = None
    singles: tuple[tuple[str, str], ...] = ()

    @property
    def known(self) -> list[str]:
        return sorted({*self.required, *self.optional})

    def fingerprints(self) -> list[Column]:
        """One for each choice of the optional paths."""
        some = (c for k in range(len(self.optional) + 1) for c in combinations(self.optional, k))
        return [fingerprint(F.array(*map(F.lit, sorted({*self.required, *c})))) for c in some]


def _turns(name: str, array: str, role: str, text: str, parts: str | None = None) -> Layout:
    deep = f"{array}[].{text}[].{parts}" if parts else f"{array}[].{text}"
    return Layout(name, (array, f"{array}[].{role}", deep), (), array, role, text, parts)


#: Role names in canonical form; others stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant"}
LAYOUTS = (
    _turns("message_parts", "messages", "role", "content", "text"),
    _turns("messages", "messages", "role", "content"),
    _turns("messages_from", "messages", "from", "value"),
    _turns("conversations", "conversations", "from", "value"),
    _turns("conversations_role", "conversations", "role", "content"),
    _turns("conversation", "conversation", "role", "content"),
    _turns("dialog", "data.dialog", "speaker", "utterance"),
    Layout("instruction", ("instruction", "output"), ("input", "system"), singles=(("system", "system"), ("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction_response", ("instruction", "response"), ("context",), singles=(("system", "context"), ("user", "instruction"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), singles=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), singles=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), ("context",), singles=(("system", "context"), ("user", "question"), ("assistant", "answer"))),
    # Arrays without elements have no paths below them.
    *(Layout(f"{a}_empty", (a,), array=a) for a in ("messages", "conversations", "conversation")),
)
#: Columns of tables whose rows are turns: (role, text).
ROWS = (("role", "text"), ("role", "content"), ("from", "value"), ("speaker", "utterance"))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def variant_paths(v: Column) -> Column:
    """All field paths of a variant at any depth: its schema's text, read sign by sign with a stack of prefixes."""
    name = r"`(?:[^`]|``)*`: |[^<>:, `]+: "
    signs = F.regexp_extract_all(F.schema_of_variant(v), F.lit(rf"{name}|OBJECT<|ARRAY<|>"), F.lit(0))
    text, none = F.lit(""), F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), text.alias("at"), none.alias("paths"))

    def step(state: Column, sign: Column) -> Column:
        stack = state["stack"]
        field = F.regexp_replace(F.regexp_replace(sign, "^`|`?: $", ""), "``", "`")
        path = F.concat(F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("")), field)
        opened = F.when(sign == "ARRAY<", F.concat(state["at"], F.lit("[]"))).otherwise(state["at"])
        prefix = F.when(opened == "", "").otherwise(F.concat(opened, F.lit(".")))
        out = F.struct(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))).alias("stack"), state["at"].alias("at"), state["paths"].alias("paths"))
        out = F.when(sign == ">", out).when(
            sign.endswith("<"), F.struct(F.concat(stack, F.array(prefix)).alias("stack"), opened.alias("at"), state["paths"].alias("paths")))
        return out.otherwise(F.struct(stack.alias("stack"), path.alias("at"), F.concat(state["paths"], F.array(path)).alias("paths")))

    return F.aggregate(signs, start, step)["paths"]


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for a, b in ROLES.items():
        out = F.when(role == a, b).otherwise(out)
    return out


def _made(lay: Layout, v: str) -> Column:
    """The turns of a record of one layout; null where its values aren't of that form."""
    if lay.array and not lay.role:
        items = F.try_variant_get(v, f"$.{lay.array}", "array<variant>")
        return F.when(F.size(items) == 0, F.array().cast(TURNS))
    if lay.array:
        text = f"array<struct<`{lay.parts}`:string>>" if lay.parts else "string"
        items = F.try_variant_get(v, f"$.{lay.array}", f"array<struct<`{lay.role}`:string,`{lay.text}`:{text}>>")

        def turn(x: Column) -> Column:
            said = F.array_join(F.transform(x[lay.text], lambda y: y[lay.parts]), "") if lay.parts else x[lay.text]
            return F.struct(_role(x[lay.role]).alias("role"), F.coalesce(said, F.lit("")).alias("text"))

        return F.transform(items, turn)
    one = [F.struct(F.lit(r).alias("role"), F.try_variant_get(v, f"$.{p}", "string").alias("text")) for r, p in lay.singles]
    made = F.filter(F.array(*one), lambda x: F.coalesce(x.text, F.lit("")) != "")
    orphan = ~F.exists(made, lambda x: x.role == "user")
    return F.transform(made, lambda x, i: F.struct(F.when(orphan & (i == 0) & (x.role == "system"), "user").otherwise(x.role).alias("role"), x.text.alias("text")))


def canonical_turns(records: DataFrame, json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """JSON records of any known layout with ``layout``, ``fingerprint`` (of all paths), ``turns`` (array of role, text) and
    ``unread``: whether there is a record that couldn't be parsed."""
    v = F.try_parse_json(json_col)
    out = records.withColumn("__v", v).withColumn("__paths", F.array_distinct(variant_paths(F.col("__v"))))
    out = out.withColumn("fingerprint", fingerprint(F.col("__paths")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for lay in reversed(layouts):
        mine = fingerprint(F.array_intersect("__paths", F.array(*map(F.lit, lay.known)))).isin(*lay.fingerprints())
        made = _made(lay, "__v")
        name, turns = F.when(mine & made.isNotNull(), lay.name).otherwise(name), F.when(mine & made.isNotNull(), made).otherwise(turns)
    unread = F.col(json_col).isNotNull() & F.col("__v").isNull()
    return out.withColumns({"layout": name, "turns": turns, "unread": unread}).drop("__v", "__paths")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_turns(df: DataFrame, turns: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """Adds ``segments`` (array of text, loss) and ``formatted``, which is the segments' texts joined."""
    def segs(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t.role), F.lit(BODY))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t.text).alias("text"), (t.role == trained_role).alias("loss")),
            F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
        )

    out = df.withColumn("segments", F.flatten(F.transform(turns, segs)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def parse_formatted(formatted: Column) -> Column:
    """The turns, read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, BODY, -1), CLOSE, 1)).alias("text"),
        ),
    )


def turns_from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``conv_id``, ``fingerprint``, ``layout`` and ``turns`` of each conversation, its rows in order; no JSON in between.

    The first of ``ROWS`` whose columns the table has is its layout.
    """
    found = next(((r, t) for r, t in ROWS if {r, t} <= set(rows.columns)), None)
    if found is None:
        raise ValueError(f"no layout for rows with the columns {rows.columns}")
    role, text = found
    ordered = F.array_sort(F.collect_list(F.struct(
        F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63))).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))))
    turns = F.transform(ordered, lambda x: F.struct((x.role if role == "role" else _role(x.role)).alias("role"), x.text.alias("text")))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(turns.alias("turns")).select(
        "conv_id", fingerprint(F.array(*map(F.lit, found))).alias("fingerprint"), F.lit(f"rows_{role}_{text}").alias("layout"), "turns")


def read_back(df: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask say."""
    masked = F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text))
    out = df.withColumns({"__t": parse_formatted(F.col("formatted")), "__m": F.array_join(masked, "")})
    said = F.array_join(F.transform("__t", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "conv_id", F.size("__t").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
        F.length("__m").cast("long").alias("loss_chars"), sha(F.col("__m")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_turns(turns_from_rows(rows.unionByName(probe))))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations as JSON records of four layouts (by the id's remainder), recognised, formatted and read back."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    turns = turns_from_rows(rows).select("conv_id", "turns")

    def record(name: str, field: str, role: str, text: str) -> tuple[Column, str]:
        said = F.transform("turns", lambda t: F.struct(t.role.alias(role), t.text.alias(text), F.lit(1).alias("weight")))
        return F.to_json(F.struct(F.col("conv_id").alias("id"), said.alias(field))), name

    parts = F.transform("turns", lambda t: F.struct(t.role.alias("role"), F.array(F.struct(F.lit("text").alias("type"), t.text.alias("text"))).alias("content")))
    made = [record("messages", "messages", "role", "content"), record("conversations", "conversations", "from", "value"),
            record("messages_from", "messages", "from", "value"), (F.to_json(F.struct(parts.alias("messages"))), "message_parts")]
    chosen = made[0][0]
    for k, (text, _) in enumerate(made):
        chosen = F.when(F.pmod("conv_id", F.lit(len(made))) == k, text).otherwise(chosen)
    return read_back(format_turns(canonical_turns(turns.select("conv_id", chosen.alias("record")))))


SQL = r"""
WITH r AS (SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 23 AS laid FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(laid) AS BIGINT) AS formatted_chars, 'rows_role_text' AS layout
FROM e GROUP BY conv_id
"""
LAYOUTS_SQL = SQL.replace("UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')", "WHERE conv_id IS NOT NULL").replace(
    "'rows_role_text' AS layout", "CASE conv_id % 4 WHEN 0 THEN 'messages' WHEN 1 THEN 'conversations' WHEN 2 THEN 'messages_from' ELSE 'message_parts' END AS layout")
