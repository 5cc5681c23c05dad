"""Spelling variants against all pairs of words."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from formlake.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows, every, least_length, least_count):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_near(n):
    """Of each word the near ones, the best first."""
    found = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            found[a].append(b)
            found[b].append(a)
    return {w: sorted(others, key=lambda o: (-n[o], o)) for w, others in found.items()}


def slow(n, ratio):
    found = slow_near(n)
    form = {w: others[0] if others and n[others[0]] >= ratio * n[w] else None for w, others in found.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(found[w]), n[form[w]] if form[w] else None) for w in n}


def as_dict(frame):
    rows = frame.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_table_matches_all_pairs(spark, docs, rows):
    n = counted([(d, t) for d, t, _ in rows], 7, 7, 2)
    assert 500 < len(n) < 5000
    assert as_dict(variants.variants(docs, 7, 7, 2)) == slow(n, 5)


def test_planted_variants(spark):
    texts = [("Ähnlich receive recieve " * 30) + "receve receves receiver", "receive " * 200 + "receiVe, receivé receivé", None, "", "12 ...", "àbcdef abcdef " * 5, "Receiving " * 9]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(1, "receve receivè " * 3), (1, "receve receivè " * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS word", "doc_id AS n", "text AS form")
    n = counted(rows, 199, 6, 2)
    assert as_dict(variants.variants(frame, 199, 6, 2)) == slow(n, 5)


def test_forms_are_followed_to_the_last(spark):
    chain = {"aaaaaa": 5000, "aaaaab": 900, "aaaabb": 170, "aaabbb": 33, "aabbbb": 6, "zzzzzz": 1}
    text = " ".join(w for w, k in chain.items() for _ in range(k))
    got = as_dict(variants.variants(spark.createDataFrame([(0, text)], "doc_id long, text string"), 1 << 40, 6, 1))
    assert {w: r[1] for w, r in got.items()} == {**{w: "aaaaaa" for w in chain}, "zzzzzz": "zzzzzz"}


@pytest.mark.parametrize("size", [3, 8])
def test_cells_and_parts(spark, monkeypatch, size):
    """Small cells: many splits, cells of equal counts over several tasks, and the same near words."""
    rng = np.random.default_rng(size)
    words = {"".join(rng.choice(list("abcdé"), rng.integers(size, size + 3))) for _ in range(900)}
    words |= {"".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 300)}
    n = {w: int(k) for w, k in zip(sorted(words), rng.integers(1, 50, len(words)))}
    monkeypatch.setattr(variants, "CELL_WORDS", 16)
    got = {r["word"]: tuple(r)[1:] for r in variants.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert got == {w: (len(others), others[0], n[others[0]]) for w, others in slow_near(n).items() if others}


def test_very_long_words(spark):
    long = "ab" * 20000
    rows = [(1, f"{long} {long}x {long[:-1]}c"), (2, long)]
    n = counted(rows, 199, 6, 1)
    assert as_dict(variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), 199, 6, 1, 2)) == slow(n, 2)


def test_odd_and_empty_tables(odd, empty):
    assert variants.variants(empty).collect() == []
    assert variants.variants(odd).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_edit_moves_the_counts_by_two_at_most():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 4, size=(400, 90))
    queries = np.r_[points[:50], np.abs(points[:150] + rng.integers(-1, 2, size=(150, 90)) * (rng.random((150, 90)) < 0.02))]
    for reach in (0, 1, 2):
        got = {(int(i), int(j)) for a, b in variants.within(points, queries, reach) for i, j in zip(a, b)}
        away = np.abs(queries[:, None, :] - points[None, :, :]).sum(axis=2)
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(away == reach))))
