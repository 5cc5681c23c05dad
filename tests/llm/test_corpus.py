"""Mixing, language scores, token shards, nearest vectors, URL lists and the pipeline against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from formlake.llm import common, decontaminate, language, mixing, nearest, simhash, tokens, toxicity, urls

from .conftest import FOLDER

# ---- mixing ---------------------------------------------------------------------------


def test_mix_reaches_targets_and_spreads_sources(docs):
    sized = docs.select("doc_id", "source", common.word_total("text").alias("size"))
    targets = mixing.source_targets(sized)
    placed = mixing.streams(sized, targets)
    parts = mixing.mix(placed, targets, block=64).collect()
    words = Counter()
    for r in parts:
        words[r["source"]] += r["to"] - r["from"]
    want = {r["source"]: r["words"] for r in targets.collect()}
    assert words == {s: w for s, w in want.items() if w}
    by_place = sorted({(r["place"], r["source"]) for r in parts})
    assert len({p for p, _ in by_place}) == len(by_place)  # a slot has one source
    half, total = Counter(s for _, s in by_place[: len(by_place) // 2]), Counter(s for _, s in by_place)
    assert all(abs(half[s] - total[s] / 2) <= 2 + math.log2(len(by_place)) for s in total)


def test_mix_of_odd_rows(odd, empty):
    got = mixing.document_shares(odd).collect()
    assert len(got) == 8 and all(r["taken"] <= 3 * r["size"] for r in got)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in got}
    total = sum(s for s, _ in sources.values())
    assert set(sources) == {None, "", "a", "b"} and abs(sum(t for _, t in sources.values()) - total) < 1e-6
    assert sources[None][1] == 15.0 and sources["b"][1] == 15.0  # three times five words
    assert mixing.document_shares(empty).collect() == []
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.filter("doc_id = 1").count() == 6
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
    assert mixing.mixed_documents(empty).collect() == []


# ---- language model -------------------------------------------------------------------


def slow_base(rows):
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    toks = [(d, out(d), language.tokens_of((t or "").encode())) for d, t in rows]
    counts = Counter(w for _, held, ws in toks if not held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(d, held, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, held, ws in toks]


def test_language_base_and_gain(docs, rows, monkeypatch):
    monkeypatch.setattr(language, "BLOCK_BYTES", 1 << 16)  # several blocks
    got = {r["doc_id"]: r for r in language.scored_documents(docs).collect()}
    for d, held, n, known, train, base in slow_base([(d, t) for d, t, _ in rows]):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_of_odd_rows(odd, empty):
    order = lambda x: sorted(x, key=repr)
    want = slow_base([(r["doc_id"], r["text"]) for r in odd.collect()])
    got = language.scored_documents(odd).collect()
    assert order([tuple(r)[:5] for r in got]) == order([w[:5] for w in want])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language.scored_documents(empty).collect() == []


def test_language_learns_from_every_document(spark):
    """A pattern that only documents beyond the first 1,500 by hash hold, and held-out documents with it and without."""
    ids = spark.range(5000).select("id", language.held_out("id").alias("held"), F.xxhash64("id").alias("place")).orderBy("place", "id").collect()
    early = {r["id"] for r in [r for r in ids if not r["held"]][:1500]}
    held = [r["id"] for r in ids if r["held"]]
    rng, words = np.random.default_rng(1), [f"w{i}" for i in range(8)]

    def text(i: int) -> str:
        if i in early or i in held[::2]:
            return " ".join(rng.choice(words, 32))
        at = int(rng.integers(0, 8))
        return " ".join(words[(at + j) % 8] for j in range(32))

    frame = spark.createDataFrame([(r["id"], text(r["id"])) for r in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language.scored_documents(frame).collect()}
    assert np.mean([got[i] for i in held[1::2]]) > np.mean([got[i] for i in held[::2]]) + 10


def test_model_is_a_distribution():
    head = [(f"w{i}".encode(), 60 - i) for i in range(45)]
    bins = np.zeros(language.BINS, np.int64)
    bins[0], bins[2] = 7, 9
    words = language.Vocabulary(head, bins)
    model = language.Gru(words)
    symbols = np.array([*range(45), words.n_head, words.n_head + 2, words.unknown], np.int32)
    states = np.random.default_rng(0).normal(0, 1, (1, language.STATE)).astype(np.float32)
    total = np.exp(model.log_probability(np.repeat(states, len(symbols), axis=0), symbols)).sum()
    assert abs(total - 1) < 1e-4
    counts = np.array([1, 5])
    shares = np.exp(words.within(np.array([words.n_head, words.n_head + 2]), counts))
    assert np.allclose(shares, [1 / 7, 5 / 9])


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(language, "GROUP", 4)
    monkeypatch.setattr(language, "STATE", 5)
    rng = np.random.default_rng(0)
    bins = np.zeros(language.BINS, np.int64)
    bins[:3] = [30, 20, 10]
    words = language.Vocabulary([(b"w%d" % i, 50 - i) for i in range(10)], bins)
    model = language.Gru(words)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    symbols = rng.choice([*range(12), words.unknown], (6, 3))
    inputs = np.vstack([np.full((1, 3), words.start), symbols[:-1]])
    live = np.ones((6, 3), bool)
    live[4:, 2] = False
    state = np.zeros((3, 5))
    _, g, _ = model.gradients(symbols, inputs, live, state)
    for k, value in model.p.items():
        for _ in range(4):
            i, kept = tuple(rng.integers(0, s) for s in value.shape), 0.0
            kept, losses = value[i], []
            for e in (1e-5, -1e-5):
                value[i] = kept + e
                losses.append(model.gradients(symbols, inputs, live, state)[0])
            value[i] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 / live.sum() - g[k][i]) < 1e-5


# ---- token shards ---------------------------------------------------------------------


def test_shards_match_the_library(docs, rows):
    library = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got, at = {r["doc_id"]: tuple(r)[1:] for r in tokens.encoded_documents(docs).collect()}, 0
    for d, text, _ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("text", [
    "", " ", "  a  b", " x", "x ", "it's I'll don't   \n\n z", " 日本 語 ñandú", "a\x85 b", "a\x1c b", " <|endoftext|> x", "́x y", "İ ſ ǅ ʰ x²", "１２ ٣", "a\n b", "'S 'll 're '",
])
def test_pieces_are_encoded_as_the_whole_text(text):
    place = public_tokenizers.path(tokens.TOKENIZER)
    want = Tokenizer.from_file(place).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.Encoder(place).encode(text), np.uint32).tolist() == want


def test_shard_answers_from_its_planes():
    ids = np.random.default_rng(3).integers(0, 300, 5000).astype(np.uint32)
    shard = tokens.Shard(tokens.pack_shard(ids, [5, None], [2000, 3000]))
    assert (shard.ids() == ids).all() and shard.doc_ids == [5, None] and shard.lengths.tolist() == [2000, 3000]
    assert [shard.access(i) for i in (0, 1023, 1024, 4999)] == ids[[0, 1023, 1024, 4999]].tolist()
    for token in (0, 7, 299, 511, 100000):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places) and shard.count(token, 900, 3100) == ((places >= 900) & (places < 3100)).sum()
        assert [shard.occurrence(token, n) for n in range(len(places))] == places.tolist()
    with pytest.raises(IndexError):
        shard.occurrence(100000, 0)


def test_shards_of_odd_rows(odd, empty, monkeypatch):
    got = sorted(tokens.encoded_documents(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 2, 3, 4, 5]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert got[4]["n_tokens"] == 1
    assert tokens.encoded_documents(empty).collect() == []


# ---- nearest vectors ------------------------------------------------------------------


def slow_top(vectors, k):
    out = []
    for q, v in vectors:
        if q is not None and q % 20 == 0 and v is not None:
            scores = []
            for x, w in vectors:
                if x is not None and x != q and w is not None:
                    n = min(len(v), len(w))
                    scores.append((-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(v[:n], w[:n])), x))
            out += [(q, i + 1, x, -s) for i, (s, x) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_with_ties_repeats_and_invalid_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nearest, "CHUNK_QUERIES", 3)
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 1, 6).round(1).tolist()) for i in range(200)] + [(i, [0.5] * 6) for i in range(200, 300)]
    vectors += [(40, [1.0, 0.0]), (7, [0.25] * 6), (301, []), (320, [9000.0] * 6)]
    bad = [(302, None), (303, [1.0, None]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame([(*v, 0, 1.0) for v in vectors + bad], "vec_id long, embedding array<double>, row int, dist double")
    got = nearest.top_k(frame, F.col("vec_id") % 20 == 0, k=5, scale=64)
    assert sorted(map(tuple, got.collect())) == slow_top(vectors, 5)
    assert nearest.top_k(frame.limit(0), F.col("vec_id") % 20 == 0, k=5, scale=64).collect() == []
    few = frame.filter("vec_id IN (0, 1, 2)")
    assert [r["rank"] for r in nearest.top_k(few, F.col("vec_id") % 20 == 0, k=5, scale=64).collect()] == [1, 2]


def test_scores_beyond_doubles_are_exact():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**40, 1.0]])
    assert nearest._scores(q, x).tolist() == [[2**60 + 3, np.iinfo(np.int64).max]]


# ---- URL lists ------------------------------------------------------------------------


def test_rules_hold_only_in_their_interval(spark):
    entries = [
        ("l", "host", "A.example.", "block", "2021-02-01"), ("l", "host", "a.example", "remove", "2021-03-01"), ("l", "host", "a.example", "block", "2022-01-01"),
        ("l", "domain", "example", "allow", "2020-01-01"), ("l", "prefix", "b.example/x/", "block", "2021-01-01"), ("m", "prefix", "b.example/x/y", "allow", "2021-06-01"),
        ("l", "host", None, "block", "2020-01-01"), ("l", "host", "c.example", "unknown", "2020-01-01"), ("l", "host", "d.example", "block", None),
        ("l", "host", "e.example", "block", "2021-01-01"), ("l", "host", "e.example", "remove", "2021-01-01"),
    ]
    log = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, day string").withColumn("listed_at", F.to_timestamp("day"))
    asked = [
        ("http://a.example/", "2021-01-31", True), ("https://u:p@A.EXAMPLE.:8080/q?x", "2021-02-01", False), ("http://a.example", "2021-03-01", True),
        ("http://a.example", "2025-01-01", False), ("http://b.example/x/y/z", "2021-05-31", False), ("http://b.example/x/y/z", "2021-06-01", True),
        ("http://b.example/xy", "2022-01-01", True), ("//b.example//x#f", "2022-01-01", False), ("http://c.example", "2022-01-01", True),
        ("http://d.example", "2022-01-01", True), ("http://e.example", "2021-01-01", False), (None, "2022-01-01", True), ("", "2022-01-01", True),
        ("http://a.example", None, True), ("http://a.example", "2025-01-01", False), ("mailto:x", "2022-01-01", True),
    ]
    frame = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n int, url string, day string, want boolean")
    captures = frame.withColumn("fetched_at", F.to_timestamp("day")).selectExpr("*", "n AS row", "'k' AS keys")
    got = urls.filtered(captures, log).collect()
    assert len(got) == len(asked)
    assert [r["n"] for r in got if r["kept"] != r["want"]] == []
    clash = urls.filtered(captures.selectExpr("*", "'own' AS host", "n AS kept", "url AS rule_list"), log)
    assert len(set(clash.columns)) == len(clash.columns) and {r["capture_host"] for r in clash.select("capture_host", "host").collect()} == {"own"}
    same = [c for c in clash.columns if not c.startswith("capture_")]
    assert sorted(map(str, clash.select(*same).collect())) == sorted(map(str, urls.filtered(captures, log).select(*same).collect()))
    assert all(r["kept"] for r in urls.filtered(captures, log.limit(0)).collect())
    assert urls.filtered(captures.limit(0), log).collect() == []


# ---- pipeline -------------------------------------------------------------------------


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (2000, 1030)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(61)} | {2000: 1000}
    assert got == want


def test_pipeline_follows_its_operators(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    score = {r["doc_id"]: r["score"] for r in toxicity.scored_documents(docs, labels).collect()}
    kept = docs.filter(F.col("doc_id").isin([d for d, s in score.items() if s < 0.5]))
    groups = simhash.near_duplicates(kept).collect()
    kept = kept.filter(F.col("doc_id").isin([r["doc_id"] for r in groups if r["doc_id"] == r["component_id"]]))
    dirty = ids(decontaminate.contamination(kept, bench).filter("contaminated"))
    kept = kept.filter(~F.col("doc_id").isin(sorted(dirty)))
    shares = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.document_shares(kept).collect() if r["size"]}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert Counter(r["doc_id"] for r in got) == {d: n for d, n in shares.items() if n}
    assert [r["start"] for r in sorted(got, key=lambda r: r["start"])] == [0, *np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1].tolist()]


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, str(tmp_path)).columns == odd.columns
    assert corpus_pipeline.drop_contaminated(spark, odd, str(tmp_path)).filter("doc_id IN (4, 5)").count() == 0
