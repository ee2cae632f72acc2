"""Fill-in-the-middle: containers against sorted lists, offsets against a regular expression, round trips."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import fillmiddle, kernels

from .common import corpus, empty, table, with_nulls

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    """The contract, token by token."""
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    form, output = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < 20 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return doc_id, len(tokens), form, len(prefix), len(middle), output


@pytest.mark.parametrize(
    ("members", "kind"),
    [
        (range(0, 60_000, 2), fillmiddle.BitmapContainer),
        (range(0, 60_000, 20), fillmiddle.ArrayContainer),
        (range(5, 65_536), fillmiddle.RunContainer),
        ([*range(100), 200, *range(65_000, 65_536)], fillmiddle.RunContainer),
        ([65_535], fillmiddle.ArrayContainer),
    ],
)
def test_containers_select_their_members(members, kind):
    low = np.array(members)
    found = fillmiddle.container(low)
    assert type(found) is kind
    assert [found.select(k) for k in range(len(low))] == list(members) if len(low) < 5000 else [found.select(k) for k in range(0, len(low), 997)] == list(members)[::997]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400_000), min_size=1, max_size=300), st.integers(1, 40))
def test_set_in_parts_selects_like_a_sorted_list(members, parts):
    offsets = np.array(sorted(members))
    found = fillmiddle.BoundarySet()
    for part in np.array_split(offsets, parts):
        found.add(part)
    assert len(found.close()) == len(offsets)
    assert [found.select(k) for k in range(len(offsets))] == offsets.tolist()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from("abZ <é猫🎉\n"), max_size=60), st.integers(1, 7))
def test_boundaries_are_those_of_the_tokens_however_a_text_is_cut(text, chunk):
    kept, kernels.CHUNK = kernels.CHUNK, chunk
    try:
        found = fillmiddle.boundaries(np.frombuffer(text.encode(), dtype=np.uint8))
    finally:
        kernels.CHUNK = kept
    assert [found.select(k) for k in range(len(found))] == [m.start() for m in TOKEN.finditer(text)] + [len(text)]


def test_rows_equal_the_contract(spark):
    texts = [*corpus(), "a <P> b", "x<S>", "<M>", "<<P", "猫が。好き<é🎉 ok", "word " * 50_000, "猫" * 70_000, "a" * 140_000, "a.b" * 50_000]
    texts += [f"<{'<S' * (i % 3)}text {i} of {'many ' * (i % 7)}<" for i in range(60)]
    df = with_nulls(spark, texts)
    got = fillmiddle.fill_in_middle(df).collect()
    want = [plainly(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_come_back_from_output_and_form(spark):
    texts = [*corpus(), "<<<", "<P", "S><M", "<P>", *(f"<S{'<' * (i % 4)} {i} >M>" for i in range(80))]
    df = table(spark, texts)
    rows = fillmiddle.fill_in_middle(df)
    back = rows.select("doc_id", fillmiddle.restored(rows["output"], rows["form"]).alias("text")).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in fillmiddle.digests(rows).collect())


def test_shares_seed_and_empty_table(spark):
    df = table(spark, [f"some text {i}" for i in range(3000)])
    forms = [r.form for r in fillmiddle.fill_in_middle(df).collect()]
    assert abs(forms.count("plain") / 3000 - 0.1) < 0.03 and abs(forms.count("spm") / 3000 - 0.18) < 0.04
    assert fillmiddle.fill_in_middle(df, cut=0).where("form <> 'plain'").count() == 0
    assert fillmiddle.fill_in_middle(df, seed="2").collect() != fillmiddle.fill_in_middle(df).collect()
    assert fillmiddle.digests(fillmiddle.fill_in_middle(empty(spark))).count() == 0


def test_cuts_run_once_for_each_row(spark):
    plan = fillmiddle.digests(fillmiddle.fill_in_middle(table(spark, ["a b"])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_cuts(") == 1 and plan.count("ArrowEvalPython") == 1
