"""Arrow kernels of word labels, spans, lines and nearest keys: the words of some documents at a time as flat arrays.

A task runs them on batches of its own rows; nothing is shuffled and no document meets another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from formlake.functions.text import WHITE

DOCS_AT_ONCE = 256  # bounds the flat arrays
PAIRS_AT_ONCE = 1 << 20  # of values and keys, or words and regions
FARTHEST = 1 << 60  # beyond any cell


def on_documents(docs: DataFrame, kernel: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: T.StructType) -> DataFrame:
    """Run `kernel` on a few document rows at a time."""
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                found = kernel(batch.slice(at, DOCS_AT_ONCE))
                yield pa.RecordBatch.from_arrays([found[f.name].cast(f.type) for f in schema], schema=schema)

    return docs.mapInArrow(run, fields)


def sizes(lists: pa.Array) -> np.ndarray:
    """Elements of each list, 0 for null."""
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)


def aligned(lists: pa.Array, counts: np.ndarray) -> pa.Array:
    """The elements of all lists, each list cut or filled with nulls to its count."""
    own, flat = sizes(lists), lists.flatten()
    if np.array_equal(own, counts):
        return flat
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(np.cumsum(own) - own, counts) + inside
    return flat.take(pa.array(at, pa.int64(), mask=inside >= np.repeat(own, counts)))


def edges(box_list: pa.Array) -> list[pa.Array]:
    """x0, y0, x1 and y1 of a flat array of boxes; a side that a box lacks is null."""
    flat, own = box_list.flatten(), sizes(box_list)
    if len(own) and (own == 4).all():
        return [flat.take(pa.array(np.arange(i, len(flat), 4))) for i in range(4)]
    first = np.cumsum(own) - own
    return [flat.take(pa.array(first + i, pa.int64(), mask=own <= i)) for i in range(4)]


def extreme(values: pa.Array, starts: np.ndarray, largest: bool) -> pa.Array:
    """Least or largest value of each stretch of an array that the starts cut up; null where it has none."""
    if not len(starts):
        return values.slice(0, 0)
    numbers = np.asarray(values.to_numpy(zero_copy_only=False))
    if not values.null_count:
        return pa.array((np.maximum if largest else np.minimum).reduceat(numbers, starts), values.type)
    known = np.asarray(values.is_valid())
    own = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(values)]))[known]
    found: dict[int, object] = {}
    for i, v in zip(own.tolist(), values.drop_null().to_pylist()):
        found[i] = v if i not in found else (max if largest else min)(found[i], v)
    return pa.array([found.get(i) for i in range(len(starts))], values.type)


def hull(box_list: pa.Array, starts: np.ndarray) -> dict[str, pa.Array]:
    """Sides of the hull of each stretch of boxes."""
    return {c: extreme(v, starts, c.endswith("1")) for c, v in zip(("x0", "y0", "x1", "y1"), edges(box_list))}


def texts(words: pa.Array, starts: np.ndarray) -> pa.Array:
    """The words of each stretch that are not blank, trimmed, joined by spaces."""
    trimmed = pc.utf8_trim(words, WHITE)
    full = np.asarray(pc.fill_null(pc.greater(pc.binary_length(trimmed), 0), False).to_numpy(zero_copy_only=False), bool)
    before = np.concatenate([[0], np.cumsum(full)])
    lists = pa.ListArray.from_arrays(pa.array(before[np.r_[starts, len(full)]], pa.int32()), trimmed.filter(pa.array(full)))
    return pc.binary_join(lists, " ")


# ---- word labels ------------------------------------------------------------------------------


def best_rows(owner: np.ndarray, word: np.ndarray, token: pa.Array, label: pa.Array, score: pa.Array) -> np.ndarray:
    """Per owner and word, in their order, the row of the highest score, then the least token and label; nulls first, NaN last."""

    def numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known = np.asarray(values.is_valid().to_numpy(zero_copy_only=False), bool)
        return np.asarray(pc.fill_null(values, 0).to_numpy(zero_copy_only=False)), known

    texts = label.dictionary_encode()
    names = texts.dictionary.to_pylist()
    place = np.empty(len(names) + 1, np.int64)
    place[sorted(range(len(names)), key=lambda i: names[i].encode())] = np.arange(len(names))
    place[len(names)] = -1
    named = place[np.asarray(pc.fill_null(texts.indices, len(names)).to_numpy(zero_copy_only=False), np.int64)]
    (at, has_at), (value, has_value) = numbers(token), numbers(score.cast(pa.float64()))
    odd = np.isnan(value)
    order = np.lexsort((named, at, has_at, np.where(odd, 0.0, -value), np.where(odd, 2, has_value), word, owner))
    first = np.r_[True, (np.diff(owner[order]) != 0) | (np.diff(word[order]) != 0)] if len(order) else np.zeros(0, bool)
    return order[first]


def prediction_parts(batch: pa.RecordBatch) -> list[pa.Array]:
    """Neighbouring predictions of one document as a row: doc_id and lists of the best of each word."""
    ids = batch.column("doc_id")
    code = ids.dictionary_encode().indices.to_numpy()
    run = np.cumsum(np.r_[0, np.diff(code) != 0])[: len(code)]
    word = batch.column("word_idx").to_numpy()
    best = best_rows(run, word, *(batch.column(c) for c in ("token_idx", "label", "score")))
    starts = np.flatnonzero(np.r_[True, np.diff(run[best]) != 0])[: len(best)]
    offsets = pa.array(np.r_[starts, len(best)], pa.int32())
    rows = batch.take(pa.array(best))
    lists = [pa.ListArray.from_arrays(offsets, rows.column(c)) for c in ("word_idx", "token_idx", "label", "score")]
    return [rows.column("doc_id").take(pa.array(starts)), *lists]


def labelled_words(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Every word of the documents, as often as a document comes, with its best prediction, if any."""
    parts = batch.column("parts")
    held = parts.flatten()
    word, token, label, score = (held.field(i) for i in range(4))
    n = sizes(word)
    owner = np.repeat(np.repeat(np.arange(batch.num_rows), sizes(parts)), n)
    word, token, label, score = (x.flatten() for x in (word, token, label, score))
    words = np.asarray(word.to_numpy(zero_copy_only=False), np.int64)
    best = best_rows(owner, words, token, label, score)
    counts = np.maximum(0, np.asarray(batch.column("n_words").flatten().to_numpy(zero_copy_only=False), np.int64))
    doc = np.repeat(np.repeat(np.arange(batch.num_rows), sizes(batch.column("n_words"))), counts)
    index = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = int(max(words.max(initial=0), index.max(initial=0))) + 1
    theirs, mine = owner[best] * width + words[best], doc * width + index
    at = np.searchsorted(theirs, mine)
    found = theirs[np.minimum(at, len(theirs) - 1)] == mine if len(theirs) else np.zeros(len(mine), bool)
    rows = pa.array(best[np.minimum(at, len(theirs) - 1)] if len(theirs) else np.zeros(len(mine), np.int64), pa.int64(), mask=~found)
    return {
        "doc_id": batch.column("doc_id").take(pa.array(doc)), "word_idx": pa.array(index, pa.int32()),
        "label": pc.fill_null(label.take(rows), "O"), "score": pc.fill_null(score.cast(pa.float64()).take(rows), 0.0),
    }


# ---- spans ------------------------------------------------------------------------------------


def spans(batch: pa.RecordBatch, strict: bool) -> dict[str, pa.Array]:
    """Span rows of the documents."""
    doc, columns = found_spans(batch, strict)
    return {"doc_id": batch.column("doc_id").take(pa.array(doc))} | columns


def span_lists(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """One row per document with the array of its spans."""
    doc, columns = found_spans(batch, False)
    offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
    rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return {"doc_id": batch.column("doc_id"), "spans": pa.ListArray.from_arrays(offsets, rows)}


def found_spans(batch: pa.RecordBatch, strict: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Row number of its document and fields of every span: runs of one type; `B-` always starts a new run."""
    lists = batch.column("labels")
    counts = sizes(lists)
    owner = np.repeat(np.arange(len(counts)), counts)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    coded = lists.flatten().dictionary_encode()
    labels, code = coded.dictionary.to_pylist(), np.asarray(pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False), np.int64)
    kinds = ["O" if x == "O" else x[2:] for x in labels] + [None]  # a label that is null carries its run on
    names = {k: i for i, k in enumerate(dict.fromkeys([*kinds, "O"]))}
    kind = np.array([names[k] for k in kinds], np.int64)[code]
    outside = np.array([x == "O" for x in labels] + [False])[code]
    begins = np.array([x.startswith("B-") for x in labels] + [False])[code]
    before = np.where(index == 0, names["O"], np.r_[names["O"], kind[:-1]])[: len(kind)]
    if None in names:
        before = np.where(before == names[None], names["O"], before)
    opens = begins | (before != kind)
    if None in names:
        opens &= kind != names[None]
    ended = (index == 0) | np.r_[True, outside[:-1]][: len(outside)]
    inside = np.flatnonzero(~outside)
    starts = np.flatnonzero((opens | ended)[inside])
    run = np.cumsum((opens | ended)[inside]) - 1
    head = inside[starts]

    rows = pa.array(inside)
    words, box_list, scores = (aligned(batch.column(c), counts).take(rows) for c in ("words", "boxes", "scores"))
    known = np.asarray(scores.is_valid())
    total = np.bincount(run, np.asarray(pc.fill_null(scores, 0.0).to_numpy(zero_copy_only=False), float), len(starts))
    n = np.bincount(run, minlength=len(starts))
    text = texts(words, starts)
    kept = np.arange(len(starts))
    if strict:
        filled = np.asarray(pc.greater(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), bool)
        kept = np.flatnonzero(begins[head] & filled) if len(starts) else kept
    doc = owner[head][kept]
    first_of = np.searchsorted(doc, np.arange(len(counts)))
    typed = [list(names)[i] for i in range(len(names))]
    columns = {
        "span_id": pa.array(np.arange(len(doc)) - first_of[doc]),
        "type": pa.array(typed, pa.string()).take(pa.array(kind[head][kept])),
        "first": pa.array(index[head][kept]),
        "last": pa.array(index[head][kept] + n[kept] - 1),
        "text": text.take(pa.array(kept)),
        "score": pa.array((total / np.maximum(n, 1))[kept], mask=np.bincount(run, ~known, len(starts))[kept] > 0),
    }
    return doc, columns | {c: v.take(pa.array(kept)) for c, v in hull(box_list, starts).items()}


# ---- lines ------------------------------------------------------------------------------------


def line_starts(owner: list[int], centre: list[float], tall: list[float]) -> list[int]:
    """Where a line starts: words in order join the open line while they are within max(12, 0.8 x its height) of its mean centre."""
    starts, doc, total, n, high, reach = [], -1, 0.0, 0, 0.0, 0.0
    for at, (own, y, h) in enumerate(zip(owner, centre, tall)):
        if own == doc and -reach <= y - total / n <= reach:
            total, n = total + y, n + 1
            if h > high:
                high, reach = h, max(12.0, h * 0.8)
        else:
            starts.append(at)
            doc, total, n, high, reach = own, y, 1, h, max(12.0, h * 0.8)
    return starts


def lines(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """Line rows of the documents, a line's words from left to right."""
    doc, columns = found_lines(batch)
    return {"doc_id": batch.column("doc_id").take(pa.array(doc))} | columns


def few_lines(batch: pa.RecordBatch, most: int) -> dict[str, pa.Array]:
    """The rows of the documents with at most `most` lines of two characters or more."""
    doc, columns = found_lines(batch)
    usable = np.asarray(pc.greater_equal(pc.utf8_length(columns["text"]), 2).to_numpy(zero_copy_only=False), bool)
    rows = pa.array(np.flatnonzero(np.bincount(doc[usable], minlength=batch.num_rows) <= most))
    return {c: batch.column(c).take(rows) for c in batch.schema.names}


def found_lines(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Row number of its document and fields of every line."""
    words = batch.column("words")
    counts = sizes(words)
    trimmed = pc.utf8_trim(words.flatten(), WHITE)
    full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(trimmed), 0), False).to_numpy(zero_copy_only=False))
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    box_list = aligned(batch.column("boxes"), counts).take(pa.array(full))
    x0, y0, _, y1 = (np.asarray(v.to_numpy(zero_copy_only=False), float) for v in edges(box_list))
    centre, tall = (y0 + y1) / 2.0, np.maximum(1.0, y1 - y0)
    order = np.lexsort((x0, centre, owner))  # stable: the earlier word first
    starts = np.array(line_starts(owner[order].tolist(), centre[order].tolist(), tall[order].tolist()), np.int64)
    n = np.diff(np.r_[starts, len(order)])
    line = np.repeat(np.arange(len(starts)), n)
    order = order[np.lexsort((order, centre[order], x0[order], line))]
    doc = owner[order[starts]] if len(starts) else np.zeros(0, np.int64)
    rows = pa.array(order)
    columns = {
        "line_no": pa.array(np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(counts)))[doc]),
        "n_words": pa.array(n),
        "text": texts(trimmed.take(pa.array(full)).take(rows), starts),
    }
    return doc, columns | hull(box_list.take(rows), starts)


# ---- nearest keys -----------------------------------------------------------------------------


def sides(some: pa.Array) -> np.ndarray:
    """x0, y0, x1 and y1 of an array of structs, one row each."""
    return np.array([np.asarray(some.field(some.type.get_field_index(c)).to_numpy(zero_copy_only=False), float) for c in ("x0", "y0", "x1", "y1")])


def distances(v: np.ndarray, k: np.ndarray) -> np.ndarray:
    """`spatial.key_distance` of values to keys, column by column."""
    (vx0, vy0, vx1, vy1), (kx0, ky0, kx1, ky1) = v, k
    v_mid, k_mid = (vx0 + vx1) / 2.0, (kx0 + kx1) / 2.0
    dy, dx = np.abs((vy0 + vy1) / 2.0 - (ky0 + ky1) / 2.0), np.abs(v_mid - k_mid)
    v_tall, k_tall = np.maximum(1.0, vy1 - vy0), np.maximum(1.0, ky1 - ky0)
    shared = np.maximum(0.0, np.minimum(vy1, ky1) - np.maximum(vy0, ky0)) / np.minimum(v_tall, k_tall)
    same = (shared >= 0.35) | (dy <= np.maximum(12.0, np.maximum(v_tall, k_tall) * 0.75))
    gap = np.where(kx1 <= vx0, vx0 - kx1, np.where(vx1 <= kx0, kx0 - vx1, 0.0))
    base = np.where(same, gap + dy * 2, np.sqrt(dx * dx + dy * dy))
    return base + np.where(k_mid <= v_mid, 0.0, 250.0) + np.where(same, 0.0, 100.0)


def nearest(v: np.ndarray, k: np.ndarray, ids: np.ndarray, reaches: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of one document the nearest key of every value and its distance; the smallest of `ids` wins ties.

    Keys are in order of their vertical centre. A key that is `reach` or more away vertically has a distance of at least
    min(reach + 100, 2 * reach); so a value looks at the keys within the first reach, and at
    more of them only if none of those is nearer than that.
    """
    centres, middle = (k[1] + k[3]) / 2.0, (v[1] + v[3]) / 2.0
    order = np.lexsort((ids, centres))
    k, ids, centres = k[:, order], ids[order], centres[order]
    best, found = np.full(v.shape[1], np.inf), np.zeros(v.shape[1], np.int64)
    open_ = np.arange(v.shape[1])
    for reach in (*reaches, None):
        if reach is None:
            low, n = np.zeros(len(open_), np.int64), np.full(len(open_), len(ids))
        else:
            low = np.searchsorted(centres, middle[open_] - reach)
            n = np.searchsorted(centres, middle[open_] + reach) - low
        ends = np.cumsum(n)
        at = 0
        while at < len(open_):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            some = np.arange(at, to)[n[at:to] > 0]
            at = to
            if not len(some):
                continue
            first = np.cumsum(n[some]) - n[some]
            place = np.repeat(low[some] - first, n[some]) + np.arange(n[some].sum())
            d = distances(np.repeat(v[:, open_[some]], n[some], axis=1), k[:, place])
            least = np.minimum.reduceat(d, first)
            tied = np.where(d == np.repeat(least, n[some]), ids[place], np.iinfo(np.int64).max)
            chosen = np.flatnonzero(tied == np.repeat(np.minimum.reduceat(tied, first), n[some]))
            chosen = chosen[np.searchsorted(chosen, first)]
            best[open_[some]], found[open_[some]] = least, order[place[chosen]]
        if reach is not None:
            open_ = open_[~(best[open_] < min(reach + 100, 2 * reach))]
        if not len(open_):
            break
    return found, best


def nearest_keys(batch: pa.RecordBatch, reaches: tuple[int, ...]) -> dict[str, pa.Array]:
    """Rows (doc_id, span_id, key_id, distance, key, value) of all values of documents that have keys."""
    n_keys, n_values = sizes(batch.column("keys")), sizes(batch.column("values"))
    keys, values = batch.column("keys").flatten(), batch.column("values").flatten()
    k, v = sides(keys), sides(values)
    ids = np.asarray(keys.field(keys.type.get_field_index("span_id")).to_numpy(zero_copy_only=False), np.int64)
    k_at, v_at = np.concatenate([[0], np.cumsum(n_keys)]), np.concatenate([[0], np.cumsum(n_values)])
    docs = np.flatnonzero((n_keys > 0) & (n_values > 0))
    near, far = np.zeros(len(values), np.int64), np.zeros(len(values))
    for d in docs.tolist():
        own, mine = slice(k_at[d], k_at[d + 1]), slice(v_at[d], v_at[d + 1])
        found, far[mine] = nearest(v[:, mine], k[:, own], ids[own], reaches)
        near[mine] = found + k_at[d]
    owner = np.repeat(np.arange(len(n_values)), n_values)
    rows = np.flatnonzero(n_keys[owner] > 0)
    key, value = keys.take(pa.array(near[rows])), values.take(pa.array(rows))
    return {
        "doc_id": batch.column("doc_id").take(pa.array(owner[rows])), "span_id": value.field(value.type.get_field_index("span_id")),
        "key_id": key.field(key.type.get_field_index("span_id")), "distance": pa.array(far[rows]), "key": key, "value": value,
    }


# ---- overlaps ---------------------------------------------------------------------------------


class Overlaps:
    """Pairs of a word and a region of one document whose boxes overlap; found on a grid, as in `spatial.overlap_join`."""

    def __init__(self, batch: pa.RecordBatch, cell: int):
        lists, areas = batch.column("boxes"), batch.column("regions")
        counts = sizes(lists)
        self.doc, self.regions = np.repeat(np.arange(len(counts)), counts), areas.flatten()
        self.word = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(np.arange(batch.num_rows), sizes(areas))
        parts = [self.regions.field(self.regions.type.get_field_index(c)) for c in ("x0", "y0", "x1", "y1")]
        self.w, self.r = ([own_numbers(v) for v in some] for some in (edges(lists.flatten()), parts))
        near = list(self._pairs(owner, batch.num_rows, cell))
        self.at, self.of = (np.concatenate([p[i] for p in near]) if near else np.zeros(0, np.int64) for i in (0, 1))

    def _pairs(self, owner: np.ndarray, docs: int, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, region) rows, each pair in the cell that holds the corner of its overlap."""
        sides_, reach = [], np.array([[-FARTHEST] * docs, [FARTHEST] * docs] * 2)
        for box, of in ((self.w, self.doc), (self.r, owner)):
            rows = np.flatnonzero((box[2] > box[0]) & (box[3] > box[1]))  # a box without extent overlaps nothing
            cells = np.array([np.floor(v[rows] / cell) for v in (box[0], box[2], box[1], box[3])]).astype(np.int64)
            sides_.append((rows, of[rows], cells))
            for i, (lowest, highest) in enumerate(((cells[0], cells[1]), (cells[2], cells[3]))):
                low, high = np.full(docs, FARTHEST), np.full(docs, -FARTHEST)
                np.minimum.at(low, of[rows], lowest)
                np.maximum.at(high, of[rows], highest)
                reach[2 * i], reach[2 * i + 1] = np.maximum(reach[2 * i], low), np.minimum(reach[2 * i + 1], high)
        dealt = []
        for rows, of, cells in sides_:
            # only cells that both sides of the document can have
            x0, x1, y0, y1 = (f(c, reach[i][of]) for i, (f, c) in enumerate(zip((np.maximum, np.minimum) * 2, cells)))
            wide, tall = np.maximum(0, x1 - x0 + 1), np.maximum(0, y1 - y0 + 1)
            n = wide * tall
            row = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            dealt.append((rows[row], of[row], x0[row] + inside % wide[row], y0[row] + inside // wide[row]))
        if not all(len(d[0]) for d in dealt):
            return
        low, high = [min(int(d[i].min()) for d in dealt) for i in (2, 3)], [max(int(d[i].max()) for d in dealt) for i in (2, 3)]
        (word, *at), (region, *of) = dealt
        key = lambda d, x, y: (d * (high[0] - low[0] + 1) + x - low[0]) * (high[1] - low[1] + 1) + y - low[1]
        held = key(*of)
        order = np.argsort(held, kind="stable")
        held, region, asked = held[order], region[order], key(*at)
        first = np.searchsorted(held, asked)
        fan = np.searchsorted(held, asked, side="right") - first
        ends, begin = np.cumsum(fan), 0
        while begin < len(asked):
            to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
            n = fan[begin:to]
            place = np.repeat(first[begin:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a, b = np.repeat(word[begin:to], n), region[place]
            x, y = np.maximum(self.w[0][a], self.r[0][b]), np.maximum(self.w[1][a], self.r[1][b])
            over = (x < np.minimum(self.w[2][a], self.r[2][b])) & (y < np.minimum(self.w[3][a], self.r[3][b]))
            over &= (np.floor(x / cell) == np.repeat(at[1][begin:to], n)) & (np.floor(y / cell) == np.repeat(at[2][begin:to], n))
            yield a[over], b[over]
            begin = to

    def areas(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every pair the areas of the word, the region and their overlap."""
        def area(x0, y0, x1, y1):
            return np.maximum(0.0, (x1 - x0).astype(np.float64)) * np.maximum(0.0, (y1 - y0).astype(np.float64))

        a, b = [v[self.at] for v in self.w], [v[self.of] for v in self.r]
        return area(*a), area(*b), area(*map(np.maximum, a[:2], b[:2]), *map(np.minimum, a[2:], b[2:]))

    def iou(self) -> np.ndarray:
        word, region, inter = self.areas()
        joined = word + region - inter
        return np.where((inter > 0) & (joined > 0), inter / np.where(joined > 0, joined, 1.0), 0.0)

    def coverage(self) -> np.ndarray:
        word, _, inter = self.areas()
        return inter / np.maximum(word, 1.0)

    def keep(self, rows: np.ndarray) -> None:
        self.at, self.of = self.at[rows], self.of[rows]

    def field(self, name: str) -> pa.Array:
        """A region's field of every pair."""
        return self.regions.field(self.regions.type.get_field_index(name)).take(pa.array(self.of))


def own_numbers(values: pa.Array) -> np.ndarray:
    """As numpy in their own precision, whole numbers as long; null is NaN."""
    numbers = np.asarray(values.to_numpy(zero_copy_only=False))
    return numbers.astype(np.int64) if numbers.dtype.kind in "iu" else numbers.astype(np.float64) if numbers.dtype.kind == "O" else numbers


def places(values: pa.Array, descending: bool = False) -> np.ndarray:
    """Order of the values as numbers, nulls lowest of all; text is compared by its bytes."""
    coded = values.dictionary_encode()
    names = coded.dictionary.to_pylist()
    place = np.empty(len(names) + 1, np.int64)
    sorted_ = sorted(range(len(names)), key=lambda i: names[i].encode() if isinstance(names[i], str) else names[i], reverse=descending)
    place[sorted_], place[len(names)] = np.arange(len(names)), -1
    return place[np.asarray(pc.fill_null(coded.indices, len(names)).to_numpy(zero_copy_only=False), np.int64)]


def last_of(word: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of every word the pair that is last by the keys, the first key first; words ascend."""
    order = np.lexsort((*keys[::-1], word))
    return order[np.r_[np.diff(word[order]) != 0, True]] if len(order) else order


def best_pairs(batch: pa.RecordBatch, threshold: float, cell: int) -> tuple[Overlaps, np.ndarray, np.ndarray]:
    """Overlaps that reach the threshold, their iou, and of every word the best pair; the first region wins ties."""
    found = Overlaps(batch, cell)
    iou = found.iou()
    found.keep(near := np.flatnonzero(iou >= threshold))
    return found, iou[near], last_of(found.at, iou[near], places(found.field("region_idx"), descending=True), places(found.field("role")))


def best_regions(batch: pa.RecordBatch, threshold: float, cell: int) -> dict[str, pa.Array]:
    """Rows (doc_id, word_idx, region_idx, role, iou, label) of the words' best regions; `I-` where the word before has the same one."""
    found, iou, best = best_pairs(batch, threshold, cell)
    doc, word = found.doc[found.at[best]], found.word[found.at[best]]
    region, role = (found.field(c).take(pa.array(best)) for c in ("region_idx", "role"))
    place = places(region)
    follows = (np.diff(doc, prepend=-1) == 0) & (np.diff(word, prepend=-1) == 1) & (np.diff(place, prepend=-2) == 0) & (place >= 0)
    return {
        "doc_id": batch.column("doc_id").take(pa.array(doc)), "word_idx": pa.array(word), "region_idx": region, "role": role, "iou": pa.array(iou[best]),
        "label": tagged(follows, role),
    }


def tagged(inside: np.ndarray, role: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.array(np.where(inside, "I-", "B-"), pa.string()), role, "")


def audited(batch: pa.RecordBatch, threshold: float, cell: int) -> dict[str, pa.Array]:
    """Per document its words, and arrays of the words with a region: role of the best one, and KEY if any near region is a key."""
    found, _, best = best_pairs(batch, threshold, cell)
    role = found.field("role")
    key = np.asarray(pc.fill_null(pc.equal(role, "KEY"), False).to_numpy(zero_copy_only=False), bool)
    words = found.at[best]
    any_key = np.zeros(len(found.doc), bool)
    np.logical_or.at(any_key, found.at, key)
    offsets = pa.array(np.searchsorted(found.doc[words], np.arange(batch.num_rows + 1)), pa.int32())
    pairs = {"role": role.take(pa.array(best)), "expected": pa.array(np.where(any_key[words], "KEY", "VAL"), pa.string())}
    return {
        "doc_id": batch.column("doc_id"), "n_words": pa.array(sizes(batch.column("boxes"))),
        "marked": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(pairs.values()), names=list(pairs))),
    }


def covered(batch: pa.RecordBatch, threshold: float, cell: int) -> dict[str, pa.Array]:
    """Rows (doc_id, word_idx, label) of covered words: the last pair counts, of a pair its value; `B-` on the first word of a pair's region."""
    found = Overlaps(batch, cell)
    found.keep(np.flatnonzero(found.coverage() >= threshold))
    role, pair = found.field("role"), places(found.field("pair_idx"))
    kind = places(role)
    order = np.lexsort((found.at, kind, pair, found.doc[found.at]))
    groups = np.array([found.doc[found.at], pair, kind])[:, order]
    opens = np.r_[True, (np.diff(groups, axis=1) != 0).any(axis=0)] if len(order) else np.zeros(0, bool)
    first = np.empty(len(order), np.int64)
    first[order] = found.at[order][opens][np.cumsum(opens) - 1] if len(order) else first
    label = tagged((found.at != first), role)
    value = places(pc.equal(role, "VAL").cast(pa.int8()))
    last = last_of(found.at, pair, value, places(label))
    at = found.at[last]
    return {"doc_id": batch.column("doc_id").take(pa.array(found.doc[at])), "word_idx": pa.array(found.word[at]), "label": label.take(pa.array(last))}
