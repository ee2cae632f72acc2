"""Mixing: targets against clamping round by round, samples against a plain sort, edges, and shares by weight."""

import hashlib
import math
import re
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import mixing

from .common import SCHEMA, corpus, empty, table, with_nulls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS = "doc_id long, weight double, text string"


def clamped(sizes, weights=(1, 2, 3), most=3):
    """Targets by giving out the excess again and again; ``sizes`` by source, None last."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(rest * w[s], sum(w[x] for x in names if x not in full)) for s in names if s not in full}
        over = {s for s, t in share.items() if t > most * sizes[s]}
        if not over:
            return share | {s: Fraction(most * sizes[s]) for s in full}
        full |= over


def key(doc_id, weight, seed="1"):
    u = (int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / weight if weight > 0 else math.inf


def plainly(rows, weights):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    sized = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in sized:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = clamped(sizes), []
    for s, size in sizes.items():
        target = goal[s]
        epochs = int(target // size) if size else 0
        left = math.floor(target - epochs * size + Fraction(1, 2))
        for _, i, n in sorted(((key(i, weights.get(i, 0.5)), -1 if i is None else i, n) for i, n, x in sized if x == s)):
            part = min(n, left)
            left -= part
            out.append((None if i == -1 else i, n, size, float(target), epochs * n + part))
    return out


def close(got, want):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and math.isclose(a[3], b[3], rel_tol=1e-12)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9), st.booleans())
def test_targets_equal_clamping_round_by_round(spark, sizes, null):
    by_source = {None if null and k == 0 else f"s{k}": n for k, n in enumerate(sizes)}
    df = spark.createDataFrame(list(by_source.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = clamped(by_source)
    assert got.keys() == want.keys() and all(math.isclose(got[s], float(want[s]), rel_tol=1e-12, abs_tol=1e-12) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes), rel_tol=1e-12)


def test_names_go_by_code_point(spark):
    df = spark.createDataFrame([("é", 10), ("Z", 10), ("a", 10), (None, 10), ("", 10), ("🎉", 10)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, most=9).collect()}
    assert got == {"Z": 5.0, "a": 10.0, "é": 15.0, "": 5.0, "🎉": 10.0, None: 15.0}


def test_rows_equal_a_plain_sort(spark):
    df = with_nulls(spark, corpus() * 3)
    weights = {i: [0.1, 1.0, 2.5, 0.0][i % 4] for i in range(0, 40, 3)}
    got = mixing.mix(df, spark.createDataFrame([(i, w, "x") for i, w in weights.items()] + [(None, 9.0, "x")], WEIGHTS)).collect()
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    close(got, plainly(rows, weights))
    assert all(r.taken <= 3 * r.size for r in got)


def test_hot_source_and_repeated_rows(spark):
    rows = [(i % 400, f"{'w ' * (i % 9)}", "en", "hot" if i % 3 else f"s{i % 12}", 1, "x", None) for i in range(1200)] + [(7, "a b c", "en", "hot", 5, "x", None)] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    none = spark.createDataFrame([], WEIGHTS)
    got = mixing.mix(df, none)
    close(got.collect(), plainly([(r[0], r[1], r[3]) for r in rows], {}))
    hot = got.groupBy("source_size", "target").sum("taken").orderBy("source_size").tail(1)[0]
    assert abs(hot["sum(taken)"] - hot.target) <= 0.5 + 1e-9
    assert sorted(got.collect()) == sorted(mixing.mix(df.repartition(2), none).collect())


def test_edges(spark):
    none = spark.createDataFrame([], WEIGHTS)
    assert mixing.mix(empty(spark), none).count() == 0
    blank = mixing.mix(table(spark, [None, "", " \n"]), none).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in blank} == {(0, 0, 0.0, 0)}
    assert [(r.size, r.taken) for r in mixing.mix(table(spark, ["a b " * 100_000]), none).collect()] == [(200_000, 200_000)]


def test_label_weights(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, weight int")
    assert {r.doc_id: round(r.weight, 9) for r in mixing.label_weights(labels).collect()} == {1: 1.0, 2: 0.1, 3: 0.55}


def test_better_documents_are_sampled_more_often(spark):
    docs = spark.createDataFrame([(i, "w", "en", "a" if i < 4000 else "b", 1, "x", None) for i in range(6000)], SCHEMA)
    weights = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0, "") for i in range(6000)], WEIGHTS)
    rows = mixing.mix(docs, weights).where("source_size = 4000").collect()  # half of it is taken
    good, bad = (sum(r.taken for r in rows if r.doc_id % 2 == k) / 2000 for k in (1, 0))
    # of keys of rate 4 and 1, half are below t where exp(-4t) + exp(-t) = 1
    t = 0.3223
    assert math.isclose(good, 1 - math.exp(-4 * t), abs_tol=0.04) and math.isclose(bad, 1 - math.exp(-t), abs_tol=0.04)


def test_texts_of_a_mix(spark):
    docs = table(spark, ["one  two\nthree", " four", "five six", None])
    taken = spark.createDataFrame([(0, 3, 7), (1, 1, 1), (2, 2, 0), (3, 0, 0)], "doc_id long, size long, taken long")
    got = {(r.doc_id, r["copy"]): r.text for r in mixing.mixed_texts(docs, taken).collect()}
    assert got == {(0, 0): "one  two\nthree", (0, 1): "one  two\nthree", (0, 2): "one", (1, 0): " four"}


@pytest.mark.parametrize("text", ["  a b", "a\tb\x0bc", "", " "])
def test_words_are_cut_at_ascii_blanks(spark, text):
    assert mixing.mix(table(spark, [text]), spark.createDataFrame([], WEIGHTS)).first().size == len(WORD.findall(text))
