"""OCR payloads, word labels, spans, lines and key/value pairs.

A document is one row holding its words, boxes, labels and scores as arrays, as OCR
delivers it. Work within a document is done on those arrays, so it needs no shuffle
and no group; results leave as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from formlake.functions import boxes
from formlake.functions.arrays import bind, each, indexes, mean
from formlake.functions.text import half_even, stripped
from formlake.operators import pagekernels
from formlake.operators.blocks import ARROW_TYPES

EMPTY = "[EMPTY]"
# fixed values: windows of the label model
CHUNK, OVERLAP = 400, 50
PREDICTION = ("word_idx", "token_idx", "label", "score")

VERTEX = "array<struct<x:double,y:double>>"
LAYOUT = (
    "struct<textAnchor:struct<textSegments:array<struct<startIndex:string,endIndex:string>>>,"
    f"boundingPoly:struct<normalizedVertices:{VERTEX},vertices:{VERTEX}>,confidence:double>"
)
ITEM = f"array<struct<layout:{LAYOUT},confidence:double>>"
LANGUAGES = "array<struct<languageCode:string,confidence:double>>"
ENTITIES = "array<struct<type:string,mentionText:string,normalizedValue:struct<text:string>,confidence:double>>"
OCR_RESPONSE = (
    f"struct<document:struct<text:string,pages:array<struct<dimension:struct<width:double,height:double>,"
    f"lines:{ITEM},tokens:{ITEM},detectedLanguages:{LANGUAGES}>>,entities:{ENTITIES}>>"
)


# ---- OCR service responses ----------------------------------------------------------------


PIECE = 256  # code points


def text_pieces(full: Column) -> Column:
    """Struct of the text, its length and its pieces of 256 code points, in one pass: a place in a long text is found without counting up to it."""
    cut_up = F.regexp_extract_all(full, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def sized(pieces: Column) -> Column:
        last = F.coalesce(F.length(F.get(pieces, F.size(pieces) - 1)), F.lit(0))
        return F.struct(full.alias("full"), pieces.alias("pieces"), (F.greatest(F.size(pieces) - 1, F.lit(0)) * PIECE + last).alias("length"))

    return F.when(full.isNotNull(), bind(cut_up, sized))


def anchor_text(full: Column, anchor: Column) -> Column:
    """Text of an anchor's segments; a missing start is 0, empty or outside segments are skipped."""
    return bind(text_pieces(full), lambda t: pieced_text(t, anchor))


def pieced_text(text: Column, anchor: Column) -> Column:
    """`anchor_text` of a text cut up by `text_pieces`."""

    def start(s: Column) -> Column:
        return F.coalesce(s["startIndex"].try_cast("int"), F.lit(0))

    def end(s: Column) -> Column:
        return F.coalesce(s["endIndex"].try_cast("int"), F.lit(0))

    def part(s: Column) -> Column:
        first = F.floor(start(s) / PIECE).cast("int")
        last = F.floor((F.least(end(s), text["length"]) - 1) / PIECE).cast("int")
        near = F.array_join(F.slice(text["pieces"], first + 1, last - first + 1), "")
        inside = F.substring(near, start(s) - first * PIECE + 1, end(s) - start(s))
        return F.when(start(s) >= 0, inside).otherwise(F.substring(text["full"], start(s) + 1, end(s) - start(s)))

    kept = F.filter(anchor["textSegments"], lambda s: (end(s) > start(s)) & (start(s) < text["length"]))
    return F.coalesce(F.btrim(F.array_join(F.transform(kept, part), ""), F.lit(" \t\r\n")), F.lit(""))


def polygon_pixels(poly: Column, width: Column, height: Column) -> Column:
    """Pixel box of a polygon clamped to the page; without vertices the whole page."""

    def side(points: Column, axis: str, scale: Column, size: Column, pick) -> Column:
        values = F.transform(points, lambda p: F.coalesce(p[axis], F.lit(0.0)) * scale)
        return boxes.clamp(half_even(pick(values)), F.lit(0.0), size.cast("double")).cast("int")

    def box(points: Column, sx: Column, sy: Column) -> Column:
        return F.array(
            side(points, "x", sx, width, F.array_min), side(points, "y", sy, height, F.array_min),
            side(points, "x", sx, width, F.array_max), side(points, "y", sy, height, F.array_max),
        )

    one = F.lit(1.0)
    whole = F.array(F.lit(0), F.lit(0), F.greatest(F.lit(1), width), F.greatest(F.lit(1), height))
    return (
        F.when(F.size(poly["normalizedVertices"]) > 0, box(poly["normalizedVertices"], width.cast("double"), height.cast("double")))
        .when(F.size(poly["vertices"]) > 0, box(poly["vertices"], one, one))
        .otherwise(whole)
    )


def flatten_response(response: Column, width: Column, height: Column, use_lines: bool = False) -> Column:
    """Array of (text, box, confidence) of all pages' tokens, or lines where asked and present."""
    document = response["document"]
    none = F.array().cast("array<struct<text:string,box:array<int>,confidence:double>>")

    def item(page: Column, it: Column, text: Column) -> Column:
        w = F.coalesce(F.nullif(page["dimension"]["width"], F.lit(0.0)), width.cast("double"))
        h = F.coalesce(F.nullif(page["dimension"]["height"], F.lit(0.0)), height.cast("double"))
        layout = it["layout"]
        squeezed = F.regexp_replace(pieced_text(text, layout["textAnchor"]), r"\s+", " ")
        return F.struct(
            squeezed.alias("text"),
            polygon_pixels(layout["boundingPoly"], half_even(w).cast("int"), half_even(h).cast("int")).alias("box"),
            F.coalesce(layout["confidence"], it["confidence"], F.lit(0.0)).alias("confidence"),
        )

    def items(page: Column, text: Column) -> Column:
        source = F.when(F.size(page["lines"]) > 0, page["lines"]).otherwise(page["tokens"]) if use_lines else page["tokens"]
        return F.coalesce(F.transform(source, lambda it: item(page, it, text)), none)

    all_items = bind(text_pieces(document["text"]), lambda text: F.flatten(F.transform(document["pages"], lambda page: items(page, text))))
    found = F.filter(all_items, lambda t: F.length(t["text"]) > 0)
    blank = F.array(F.struct(F.lit(EMPTY).alias("text"), F.array(*map(F.lit, (0, 0, 1, 1))).alias("box"), F.lit(0.0).alias("confidence")))
    return bind(F.coalesce(found, none), lambda t: F.when(F.size(t) == 0, blank).otherwise(t))


def keep_confident(words: Column, box_list: Column, confidences: Column, least: float = 30) -> Column:
    """Array of (text, box, confidence) with text and confidence >= `least`; non-numeric counts as -1."""

    def item(w: Column, i: Column, bs: Column, cs: Column) -> Column:
        conf = F.coalesce(F.get(cs, i).try_cast("double"), F.lit(-1.0))
        return F.struct(stripped(w).alias("text"), F.get(bs, i).alias("box"), conf.alias("confidence"))

    rows = bind(box_list, lambda bs: bind(confidences, lambda cs: F.transform(words, lambda w, i: item(w, i, bs, cs))))
    kept = F.filter(rows, lambda t: (F.length(t["text"]) > 0) & (t["confidence"] >= least))
    blank = F.array(F.struct(F.lit(EMPTY).alias("text"), F.array(*map(F.lit, (0, 0, 1, 1))).alias("box"), F.lit(0.0).alias("confidence")))
    return bind(kept, lambda t: F.when(F.size(t) == 0, blank).otherwise(t))


# ---- sub-token predictions to word labels ---------------------------------------------------


def chunks(docs: DataFrame, n_words: str = "n_words", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows (doc_id, chunk, start, stop) over each document's words."""
    starts = F.sequence(F.lit(0), F.col(n_words) - 1, F.lit(size - overlap))
    rows = docs.filter(F.col(n_words) > 0).select("doc_id", n_words, F.posexplode(starts).alias("chunk", "start"))
    return rows.select("doc_id", "chunk", "start", F.least(F.col("start") + size, F.col(n_words)).alias("stop"))


def word_labels(predictions: DataFrame, docs: DataFrame, n_words: str = "n_words") -> DataFrame:
    """Best prediction per word, the earliest on ties; words without one are ('O', 0.0).

    predictions: doc_id, token_idx (over all chunks), word_idx, label, score. Those that follow each other in a
    document are one row of lists before they meet the others, so a word is shuffled as a few numbers, once.
    """
    rows = predictions.filter((F.col("word_idx") >= 0) & F.col("doc_id").isNotNull()).select("doc_id", *PREDICTION)
    fields = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in PREDICTION)])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(pagekernels.prediction_parts(batch), schema)], schema=schema)

    n = F.col(n_words).cast("int")
    parts = rows.mapInArrow(pack, fields).select("doc_id", F.lit(None).cast("int").alias("n_words"), F.struct(*PREDICTION).alias("part"))
    sized = docs.select("doc_id", n.alias("n_words"), F.lit(None).cast(parts.schema["part"].dataType).alias("part"))
    whole = sized.union(parts).groupBy("doc_id").agg(F.collect_list("n_words").alias("n_words"), F.collect_list("part").alias("parts"))
    out = T.StructType([docs.schema["doc_id"], T.StructField("word_idx", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
    return pagekernels.on_documents(whole.filter(F.size("n_words") > 0), pagekernels.labelled_words, out)


# ---- BIO spans --------------------------------------------------------------------------------


def label_type(label: Column) -> Column:
    return F.when(label == "O", F.lit("O")).otherwise(F.substring(label, F.lit(3), F.length(label)))


def span_bounds(labels: Column) -> Column:
    """Array of (first, last): runs of one type; `B-` always starts a new run."""

    def flag(ls: Column, label: Column, i: Column) -> Column:
        before = F.coalesce(label_type(F.get(ls, i - 1)), F.lit("O"))
        starts = label.startswith("B-") | (before != label_type(label))
        return F.when(label == "O", 0).when(starts, 1).otherwise(2)

    def runs(flags: Column) -> Column:
        where = indexes(F.size(flags))
        first = F.filter(where, lambda i: F.get(flags, i) == 1)
        last = F.filter(where, lambda i: (F.get(flags, i) != 0) & (F.coalesce(F.get(flags, i + 1), F.lit(0)) != 2))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))

    return bind(labels, lambda ls: bind(F.transform(ls, lambda x, i: flag(ls, x, i)), runs))


def box_hull(box_list: Column) -> Column:
    """Struct x0..y1 around an array of box arrays."""

    def edge(i: int, pick) -> Column:
        return pick(F.transform(box_list, lambda b: F.get(b, F.lit(i))))

    return F.struct(
        edge(0, F.array_min).alias("x0"), edge(1, F.array_min).alias("y0"), edge(2, F.array_max).alias("x1"), edge(3, F.array_max).alias("y1")
    )


def span_array(labels: Column, words: Column, box_list: Column, scores: Column) -> Column:
    """Array of spans (type, starts_b, first, last, text, score, box), in word order."""

    def span(b: Column, ls: Column, ws: Column, bs: Column, ss: Column) -> Column:
        def part(a: Column) -> Column:
            return F.slice(a, b["first"] + 1, b["last"] - b["first"] + 1)

        trimmed = F.filter(F.transform(part(ws), lambda w: stripped(w)), lambda w: F.length(w) > 0)
        return F.struct(
            label_type(F.get(ls, b["first"])).alias("type"),
            F.get(ls, b["first"]).startswith("B-").alias("starts_b"),
            b["first"].alias("first"), b["last"].alias("last"),
            F.array_join(trimmed, " ").alias("text"),
            mean(part(ss)).alias("score"),
            box_hull(part(bs)).alias("box"),
        )

    return bind(labels, lambda ls: bind(words, lambda ws: bind(box_list, lambda bs: bind(
        scores, lambda ss: F.transform(span_bounds(ls), lambda b: span(b, ls, ws, bs, ss))))))


SPAN_FIELDS = {"span_id": T.IntegerType, "type": T.StringType, "first": T.IntegerType, "last": T.IntegerType, "text": T.StringType, "score": T.DoubleType}


def spans(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Span rows (doc_id, span_id, type, first, last, text, score, x0, y0, x1, y1).

    strict: only runs opened by `B-` with non-blank text, score rounded to 4 digits.
    """
    fields = T.StructType([pages.schema["doc_id"], *span_fields(pages)])
    rows = pagekernels.on_documents(pages.select("doc_id", "labels", "words", "boxes", "scores"), lambda batch: pagekernels.spans(batch, strict), fields)
    return rows.withColumn("score", F.bround("score", 4)) if strict else rows


def span_fields(pages: DataFrame) -> T.StructType:
    side = pages.schema["boxes"].dataType.elementType.elementType
    return T.StructType([*(T.StructField(c, t()) for c, t in SPAN_FIELDS.items()), *(T.StructField(c, side) for c in boxes.Box._fields)])


def span_lists(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, spans): the rows of `spans` as one array per document; with the columns `keep` of the page."""
    fields = T.StructType([pages.schema["doc_id"], T.StructField("spans", T.ArrayType(span_fields(pages))), *(pages.schema[c] for c in keep)])
    asked = pages.select(*dict.fromkeys(("doc_id", "labels", "words", "boxes", "scores", *keep)))
    return pagekernels.on_documents(asked, lambda batch: pagekernels.span_lists(batch) | {c: batch.column(c) for c in keep}, fields)


def dedupe_spans(rows: DataFrame) -> DataFrame:
    """First span per document, type, lower-case text and box."""
    others = [c for c in rows.columns if c not in ("doc_id", "type", "x0", "y0", "x1", "y1")]
    first = F.min(F.struct("span_id", *(c for c in others if c != "span_id")))
    keys = ["doc_id", "type", "x0", "y0", "x1", "y1"]
    kept = rows.groupBy(*keys, F.lower("text").alias("folded")).agg(first.alias("f"))
    return kept.select(*keys, *(F.col(f"f.{c}").alias(c) for c in others)).select(*rows.columns)


# ---- lines ------------------------------------------------------------------------------------


def line_array(words: Column, box_list: Column) -> Column:
    """Array of lines, each an array of (x0, yc, i, text, box) from left to right.

    Words in order of centre and left edge join the open line while they are within
    max(12, 0.8 x its height) of its mean centre. Only positions of line starts are
    carried along, so the fold copies nothing per word.
    """

    def item(w: Column, i: Column, bs: Column) -> Column:
        b = boxes.of_array(F.get(bs, i))
        return F.struct(
            boxes.center_y(b).alias("yc"), b.x0.alias("x0"), i.alias("i"), stripped(w).alias("text"),
            F.get(bs, i).alias("box"), boxes.height(b).alias("h"),
        )

    def fold(items: Column) -> Column:
        start = F.struct(
            F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0.0).alias("h"), F.array().cast("array<int>").alias("starts")
        )

        def step(acc: Column, i: Column) -> Column:
            it = F.get(items, i)
            close = F.abs(it["yc"] - acc["total"] / F.greatest(acc["n"], F.lit(1))) <= F.greatest(F.lit(12.0), acc["h"] * 0.8)
            same = (acc["n"] > 0) & close
            return F.struct(
                F.when(same, acc["total"] + it["yc"]).otherwise(it["yc"]).alias("total"),
                F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
                F.when(same, F.greatest(acc["h"], it["h"])).otherwise(it["h"]).alias("h"),
                F.when(same, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(i))).alias("starts"),
            )

        return F.aggregate(indexes(F.size(items)), start, step, lambda acc: acc["starts"])

    def cut_lines(items: Column, starts: Column) -> Column:
        def line(s: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(starts, j + 1), F.size(items))
            rows = F.transform(
                F.slice(items, s + 1, stop - s),
                lambda t: F.struct(t["x0"].alias("x0"), t["yc"].alias("yc"), t["i"].alias("i"), t["text"].alias("text"), t["box"].alias("box")),
            )
            return F.sort_array(rows)

        return F.transform(starts, line)

    rows = bind(box_list, lambda bs: F.filter(F.transform(words, lambda w, i: item(w, i, bs)), lambda t: F.length(t["text"]) > 0))
    return bind(F.sort_array(rows), lambda items: bind(fold(items), lambda starts: cut_lines(items, starts)))


def line_text(line: Column) -> Column:
    return F.array_join(F.transform(line, lambda t: t["text"]), " ")


def line_box(line: Column) -> Column:
    return box_hull(F.transform(line, lambda t: t["box"]))


def lines(pages: DataFrame) -> DataFrame:
    """Line rows (doc_id, line_no, n_words, text, x0, y0, x1, y1)."""
    return pagekernels.on_documents(pages.select("doc_id", "words", "boxes"), pagekernels.lines, line_fields(pages))


def line_fields(pages: DataFrame) -> T.StructType:
    side = pages.schema["boxes"].dataType.elementType.elementType
    kinds = {"line_no": T.IntegerType, "n_words": T.IntegerType, "text": T.StringType}
    return T.StructType([pages.schema["doc_id"], *(T.StructField(c, t()) for c, t in kinds.items()), *(T.StructField(c, side) for c in boxes.Box._fields)])


def with_fallback_values(pages: DataFrame, value_spans: DataFrame) -> DataFrame:
    """Value spans, and for documents without any their lines of at least two characters, score 0."""
    bare = pages.join(value_spans.select("doc_id").distinct(), "doc_id", "left_anti")
    fallback = lines(bare).filter(F.length("text") >= 2).select(
        "doc_id", F.col("line_no").alias("span_id"), F.lit("VAL").alias("type"), "text", F.lit(0.0).alias("score"), "x0", "y0", "x1", "y1"
    )
    return value_spans.select(*fallback.columns).unionByName(fallback)


def is_key_word(word: Column) -> Column:
    """Ends with a colon, or is upper-case and at most 20 characters long."""
    upper = (word == F.upper(word)) & (word != F.lower(word))
    return word.endswith(":") | (upper & (F.length(word) <= 20))


def few_lines(pages: DataFrame, most: int) -> DataFrame:
    """The documents (doc_id, words, boxes) with at most `most` lines of two characters or more."""
    asked = pages.select("doc_id", "words", "boxes")
    return pagekernels.on_documents(asked, lambda batch: pagekernels.few_lines(batch, most), asked.schema)


def rule_pairs(pages: DataFrame, most: int = 15) -> DataFrame:
    """Pairs read off the lines: a leading key word and the rest, or the last key and the line.

    Documents with more than `most` pairs give none, so the look-back never exceeds `most` lines.
    """

    def pair(line: Column, j: Column, all_lines: Column) -> Column:
        head = F.get(line, F.lit(0))
        rest = F.slice(line, 2, F.size(line))
        key_line = is_key_word(head["text"])
        earlier = F.filter(F.slice(all_lines, 1, j + 1), lambda other: is_key_word(F.get(other, F.lit(0))["text"]))
        last = F.get(F.get(earlier, F.size(earlier) - 1), F.lit(0))
        return F.struct(
            F.coalesce(last["text"], F.lit("")).alias("key"),
            F.when(key_line, line_text(rest)).otherwise(line_text(line)).alias("value"),
            last["box"].alias("key_box"),
            F.when(~key_line, line_box(line)).when(F.size(rest) > 0, line_box(rest)).alias("value_box"),
        )

    usable = F.filter(line_array(F.col("words"), F.col("boxes")), lambda line: F.length(line_text(line)) >= 2)
    pairs = bind(
        usable, lambda ls: F.when(F.size(ls) <= most, F.transform(ls, lambda line, j: pair(line, j, ls)))
    )
    rows = each(few_lines(pages, most), ["doc_id"], pairs, "p", "pair_idx")
    key_box = [F.get("p.key_box", F.lit(i)).cast("double").alias(f"key_{c}") for i, c in enumerate(boxes.Box._fields)]
    value_box = [F.col(f"p.value_box.{c}").cast("double").alias(f"value_{c}") for c in boxes.Box._fields]
    return rows.select(
        "doc_id", "pair_idx", "p.key", "p.value", F.lit(0.0).alias("score"), F.lit("rule_based_fallback").alias("source"), *key_box, *value_box
    )


def cascade(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of `first`, and those of `second` for documents without any."""
    missing = second.join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    return first.unionByName(missing.select(*first.columns))


# ---- greedy pairing ----------------------------------------------------------------------------

BOXES = [f"{side}_{c}" for side in ("key", "value") for c in boxes.Box._fields]
DOCS_AT_ONCE = 64  # of a batch, as objects
PAIR_SCHEMA = "pair_idx int, key string, value string, score double, source string, " + ", ".join(f"{c} double" for c in BOXES)


def greedy_pairs(docs: DataFrame) -> DataFrame:
    """Keys claim values in reading order; leftover values go to the nearest key.

    docs: doc_id, keys and values, arrays of (text, score, x0, y0, x1, y1). Claims
    depend on earlier claims of the same document, so a document is one row here;
    documents run in parallel and nothing is shuffled.
    """

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", *(c.split()[0] for c in PAIR_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                docs_ = [batch.column(c).slice(at, DOCS_AT_ONCE) for c in ("doc_id", "keys", "values")]
                rows = [(doc, i, *pair) for doc, keys, values in zip(*(c.to_pylist() for c in docs_)) for i, pair in enumerate(_claim(keys or [], values or []))]
                types = [docs_[0].type, *(ARROW_TYPES[c.split()[1]] for c in PAIR_SCHEMA.split(", "))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * len(columns), types)], names=columns)

    return docs.select("doc_id", "keys", "values").mapInArrow(run, f"doc_id {kind}, {PAIR_SCHEMA}")


def _claim(keys, values) -> list[tuple]:
    """Pairs of one document, one per lower-case key text."""
    if len(keys) == 0:
        return []
    k = np.array([[s[c] for c in ("x0", "y0", "x1", "y1")] for s in keys], dtype=float)
    v = np.array([[s[c] for c in ("x0", "y0", "x1", "y1")] for s in values], dtype=float).reshape(-1, 4)
    k_mid, v_mid = (k[:, :2] + k[:, 2:]) / 2, (v[:, :2] + v[:, 2:]) / 2
    free = np.ones(len(v), dtype=bool)
    out = []

    def add(i: int, j: int | None, source: str) -> None:
        score = keys[i]["score"] if j is None else (keys[i]["score"] + values[j]["score"]) / 2
        value_box = [None] * 4 if j is None else v[j].tolist()
        out.append((keys[i]["text"], "" if j is None else values[j]["text"], round(float(score), 4), source, *k[i].tolist(), *value_box))

    for i in np.lexsort((k[:, 0], k[:, 1])):
        tall, wide = max(1, k[i, 3] - k[i, 1]), max(1, k[i, 2] - k[i, 0])
        dy = np.abs(v_mid[:, 1] - k_mid[i, 1])
        row = np.flatnonzero(free & (dy <= 1.5 * tall) & (v[:, 0] > k[i, 2]))
        below = np.flatnonzero(free & (v_mid[:, 1] > k_mid[i, 1]) & (np.abs(v_mid[:, 0] - k_mid[i, 0]) <= 1.5 * wide))
        chosen = None
        if len(row):
            chosen = row[np.lexsort((v[row, 0], dy[row]))[0]]
        elif len(below):
            chosen = below[np.argmin(v_mid[below, 1])]
        if chosen is not None:
            free[chosen] = False
        add(i, chosen, "primary")
    for j in np.flatnonzero(free):
        add(int(np.argmin(np.hypot(*(k_mid - v_mid[j]).T))), j, "nearest_key_fallback")

    kept: dict[str, tuple] = {}
    for pair in out:
        name = pair[0].casefold()
        old = kept.get(name)
        if old is None or (bool(pair[1]), pair[2]) > (bool(old[1]), old[2]):
            kept[name] = pair
    return list(kept.values())


# ---- annotations ---------------------------------------------------------------------------------

# fixed values: entity classes of the annotation format
CLASSES = ("O", "HEADER", "QUESTION", "ANSWER")


def annotation_blocks(forms: DataFrame) -> DataFrame:
    """Non-blank blocks (doc_id, block_id, class, box, first_word, words) with non-empty words only.

    `forms`: doc_id and form, an array of (id, text, label, linking, box, words).
    `first_word` counts the words of the blocks before.
    """
    blocks = F.filter("form", lambda b: F.length(stripped(b["text"])) > 0)

    def clean(b: Column) -> Column:
        label = F.upper(b["label"])
        return F.struct(
            b["id"].alias("id"),
            F.when(label.startswith("O"), F.lit("O")).otherwise(label).alias("class"),
            b["box"].alias("box"),
            F.filter(F.transform(b["words"], lambda w: w["text"]), lambda w: F.length(w) > 0).alias("words"),
        )

    def offsets(bs: Column) -> Column:
        return F.aggregate(
            bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + F.size(b["words"])))
        )

    def place(bs: Column) -> Column:
        return bind(offsets(bs), lambda at: F.transform(bs, lambda b, i: F.struct(b.alias("b"), F.get(at, i).alias("first_word"))))

    rows = each(forms, ["doc_id"], bind(F.transform(blocks, clean), place), "p")
    return rows.select(
        "doc_id", F.col("p.b.id").alias("block_id"), F.col("p.b.class").alias("class"), F.col("p.b.box").alias("box"),
        F.col("p.first_word").alias("first_word"), F.col("p.b.words").alias("words"),
    )


def annotation_labels(blocks: DataFrame, most_words: int | None = None) -> DataFrame:
    """Word rows (doc_id, word_idx, word, label): B- on a block's first word, I- on the rest.

    Words from position `most_words` on, where the model's input ends, are dropped.
    """
    rows = each(blocks, ["doc_id", "class", "first_word"], F.col("words"), "word", "j")
    known = F.col("class").isin(*CLASSES) & (F.col("class") != "O")
    tag = F.when(known, F.concat(F.when(F.col("j") == 0, F.lit("B-")).otherwise(F.lit("I-")), F.col("class"))).otherwise(F.lit("O"))
    out = rows.select("doc_id", (F.col("first_word") + F.col("j")).alias("word_idx"), "word", tag.alias("label"))
    return out if most_words is None else out.filter(F.col("word_idx") < most_words)


def annotation_relations(forms: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, from_word, to_word) for links that start at their own block and join two classed blocks."""
    blocks_ = each(forms, ["doc_id"], F.col("form"), "b")
    links = each(blocks_, ["doc_id", F.col("b.id").alias("own")], F.col("b.linking"), "link")
    own = links.filter(F.get("link", F.lit(0)) == F.col("own")).select("doc_id", "own", F.get("link", F.lit(1)).alias("other"))
    firsts = blocks.filter(F.col("class").isin(*CLASSES)).select("doc_id", "block_id", "first_word")
    start = firsts.select("doc_id", F.col("block_id").alias("own"), F.col("first_word").alias("from_word"))
    end = firsts.select("doc_id", F.col("block_id").alias("other"), F.col("first_word").alias("to_word"))
    return own.join(start.hint("merge"), ["doc_id", "own"]).join(end.hint("merge"), ["doc_id", "other"]).select("doc_id", "from_word", "to_word")
