"""Conversations in many layouts as canonical turns, and these as one text with a loss mask.

A record is a variant (or JSON text) of any nesting. Its field paths (`messages[].role`,
`data.turns[].speaker`), kept to those that some layout knows, sorted and hashed, are its
fingerprint; it selects one of the declared layouts, whose mapping gives the turns
(role, text). A layout is data: where each turn stands and what its role is called.
Fields that no layout knows don't matter; a record of unknown fingerprint, a record that is
no object and JSON that can't be read have no layout and no turns, and are counted as
unknown, not lost.

The text marks every turn by control strings. In a text, a backslash goes between `<` and `|`
(after those that are there already), so no control string can stand in it and the way
back is exact; a role also has its line ends written as %0A. The loss mask is one span of
code points for each turn, empty where the turn is not the assistant's.

A conversation may come as several records, ordered by `piece`; a variant holds at most
128 MB, so cut larger ones there. Its text is one string, so one conversation's turns do
meet in one row, at the end; everything before works on single records.

Null texts and null roles are empty. Records of null conversation id are one conversation.
Rows that repeat are turns of their own. A conversation without turns has an empty text.
No records give no rows.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formlake.functions.arrays import bind, running_sums

START, END = "<|im_start|>", "<|im_end|>"
DEPTH = 5  # levels of objects and lists that are looked through for paths
TURNS = "array<struct<role: string, text: string>>"


class One(NamedTuple):
    """A turn of fixed role: the text at a path, and below it, if there, the text at a second one."""

    role: str
    path: str
    optional: bool = False
    below: str | None = None


class Many(NamedTuple):
    """A list of turns: where it stands, its fields for role and text, and other names of roles.

    `parts` names the field of the text where the text field is a list of parts.
    """

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()
    parts: str | None = None


class Layout(NamedTuple):
    name: str
    turns: tuple[One | Many, ...]


SHORT = (("human", "user"), ("gpt", "assistant"))

#: A record belongs to the layout whose paths are its own, with any of the optional ones.
LAYOUTS = (
    Layout("messages", (One("system", "system", optional=True), Many("messages", "role", "content"))),
    Layout("message_parts", (Many("messages", "role", "content", parts="text"),)),
    Layout("from_value", (One("system", "system", optional=True), Many("conversations", "from", "value", SHORT))),
    Layout("speakers", (Many("data.turns", "speaker", "utterance"),)),
    Layout("instruction", (One("system", "system", optional=True), One("user", "instruction", below="input"), One("assistant", "output"))),
    Layout("prompt_response", (One("system", "system", optional=True), One("user", "prompt"), One("assistant", "response"))),
    Layout("prompt_completion", (One("system", "system", optional=True), One("user", "prompt"), One("assistant", "completion"))),
    Layout("prompt_messages", (Many("prompt", "role", "content"), Many("completion", "role", "content"))),
    Layout("question_answer", (One("system", "system", optional=True), One("user", "question"), One("assistant", "answer"))),
)


# ---- fingerprints --------------------------------------------------------------------


def paths_of_turn(turn: One | Many) -> tuple[list[str], list[str]]:
    """Paths that are always there, and those that may be."""
    if isinstance(turn, One):
        own = [turn.path] if not turn.optional else []
        return own, ([turn.path] if turn.optional else []) + ([turn.below] if turn.below else [])
    text = f"{turn.path}[].{turn.text}"
    return [f"{turn.path}[]", f"{turn.path}[].{turn.role}"] + ([f"{text}[]", f"{text}[].{turn.parts}"] if turn.parts else [text]), []


def path_sets(layout: Layout) -> list[list[str]]:
    always, maybe = (sum(lists, []) for lists in zip(*(paths_of_turn(t) for t in layout.turns)))
    return [sorted([*always, *some]) for n in range(len(maybe) + 1) for some in combinations(maybe, n)]


KNOWN = sorted({p for layout in LAYOUTS for s in path_sets(layout) for p in s})


def field_paths(value: Column, at: Column, depth: int) -> Column:
    """Paths below a variant; a list's elements share theirs."""
    if depth == 0:
        return F.array(at)
    fields, elements = value.try_cast("map<string, variant>"), value.try_cast("array<variant>")
    named = lambda f: F.when(at == "", f["key"]).otherwise(F.concat(at, F.lit("."), f["key"]))
    below = F.flatten(F.transform(F.map_entries(fields), lambda f: field_paths(f["value"], named(f), depth - 1)))
    listed = F.concat(at, F.lit("[]"))
    inside = F.flatten(F.transform(elements, lambda e: field_paths(e, listed, depth - 1)))
    return F.when(fields.isNotNull(), below).when(elements.isNotNull(), F.array_distinct(F.concat(F.array(listed), inside))).otherwise(F.array(at))


def hashed(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprint(record: Column) -> Column:
    """Hash of a record's sorted field paths, as far as layouts know them; null for what is no object."""
    own = field_paths(record, F.lit(""), DEPTH)
    known = F.array_sort(F.array_intersect(own, F.array(*map(F.lit, KNOWN))))
    return F.when(record.try_cast("map<string, variant>").isNotNull(), hashed(known))


def layout_of(code: Column) -> Column:
    """Name of the layout that a fingerprint selects, else null."""
    name = F.lit(None).cast("string")
    for layout in LAYOUTS:
        name = F.when(code.isin(*(hashed(F.array(*map(F.lit, s))) for s in path_sets(layout))), layout.name).otherwise(name)
    return name


# ---- turns -----------------------------------------------------------------------------


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "string")


def _role(name: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for other, role in names:
        name = F.when(name == other, role).otherwise(name)
    return F.coalesce(name, F.lit(""))


def turns_at(record: Column, turn: One | Many) -> Column:
    pair = lambda role, text: F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if isinstance(turn, One):
        text = _text(record, turn.path)
        if turn.below:
            more = F.nullif(_text(record, turn.below), F.lit(""))
            text = F.concat_ws("\n", text, more)
        own = F.array(pair(F.lit(turn.role), text))
        return F.when(text.isNotNull(), own).otherwise(F.array().cast(TURNS)) if turn.optional else own
    elements = F.coalesce(F.try_variant_get(record, f"$.{turn.path}", "array<variant>"), F.array().cast("array<variant>"))

    def text_of(e: Column) -> Column:
        if not turn.parts:
            return _text(e, turn.text)
        return F.array_join(F.transform(F.try_variant_get(e, f"$.{turn.text}", "array<variant>"), lambda p: _text(p, turn.parts)), "")

    return F.transform(elements, lambda e: pair(_role(_text(e, turn.role), turn.names), text_of(e)))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """(_doc, fingerprint, layout, turns): `_doc` is the whole row, `turns` an array of (role, text), null without a layout."""
    value = F.col(f"_doc.`{record}`")
    if records.schema[record].dataType.typeName() == "string":
        value = F.try_parse_json(value)
    rows = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("_doc"))
    coded = rows.withColumn("_value", value).withColumn("fingerprint", fingerprint(F.col("_value")))
    coded = coded.withColumn("layout", layout_of(F.col("fingerprint")))
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        found = [turns_at(F.col("_value"), t) for t in layout.turns]
        turns = F.when(F.col("layout") == layout.name, F.concat(*found) if len(found) > 1 else found[0]).otherwise(turns)
    return coded.select("_doc", "fingerprint", "layout", turns.alias("turns"))


# ---- text --------------------------------------------------------------------------------


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def formatted(turns: Column) -> Column:
    """struct(text, loss_spans): the turns as one text, and for each turn its span of loss (start, end), in code points."""

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
        return F.struct(head.alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss"))

    def whole(p: Column) -> Column:
        texts = F.transform(p, lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n")))
        at = running_sums(F.transform(p, lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END) + 1))

        def span(t: Column, base: Column) -> Column:
            start = base + F.length(t["head"])
            return F.struct(start.alias("start"), (start + F.when(t["loss"], F.length(t["body"])).otherwise(0)).alias("end"))

        return F.struct(F.array_join(texts, "").alias("text"), F.zip_with(p, at, span).alias("loss_spans"))

    return bind(F.transform(turns, parts), whole)


def parsed(text: Column, loss_spans: Column) -> Column:
    """Array of (role, text, loss) read from a formatted text: `loss` is the text under the mask, null for an empty span."""

    def turn(piece: Column, span: Column, base: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - (len(END) + 2))
        under = F.substr(F.concat(F.lit(START), piece), (span["start"] - base + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        loss = F.when(span["end"] > span["start"], unescaped(under))
        return F.struct(unescaped_role(role).alias("role"), unescaped(body).alias("text"), loss.alias("loss"))

    def whole(pieces: Column) -> Column:
        at = running_sums(F.transform(pieces, lambda p: F.length(p) + len(START)))
        spans = F.arrays_zip(loss_spans.alias("span"), at.alias("base"))
        return F.zip_with(pieces, spans, lambda p, s: turn(p, s["span"], s["base"]))

    pieces = F.split(text, F.lit(r"<\|im_start\|>"), -1)
    return bind(F.slice(pieces, F.lit(2), F.size(pieces)), whole)


def formatted_conversations(records: DataFrame, by: str, piece: str, record: str = "record") -> DataFrame:
    """(conv_id, n_records, n_unknown, text, loss_spans): the records of one `by`, in the order of `piece`, as one text."""
    found = canonical(records, record)
    part = F.struct(F.col(f"_doc.`{piece}`").alias("piece"), F.coalesce("turns", F.array().cast(TURNS)).alias("turns"))
    whole = found.groupBy(F.col(f"_doc.`{by}`").alias("conv_id")).agg(
        F.count("*").alias("n_records"), F.count_if(F.col("layout").isNull()).alias("n_unknown"), F.sort_array(F.collect_list(part)).alias("parts"),
    )
    whole = whole.withColumn("out", formatted(F.flatten(F.transform("parts", lambda p: p["turns"]))))
    return whole.select("conv_id", "n_records", "n_unknown", "out.text", "out.loss_spans")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from (conv_id, text, loss_spans): counts and digests of turns and of the text under the mask."""
    read = conversations.select("conv_id", F.length("text").alias("formatted_chars"), parsed(F.col("text"), F.col("loss_spans")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
