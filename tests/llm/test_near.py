"""Line dedup, the Jaccard join, components and substring dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gleanery.llm import linededup, queries, setjoin, substring
from gleanery.llm.components import components

from .common import WORDS, corpus, edited, empty, rows, soup, table, with_nulls


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None) -> frozenset:
    w = WORDS.findall(fold(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def roots(n: int, links) -> dict[int, int]:
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(n)}


def brute_components(texts: list) -> dict[int, int]:
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return roots(len(texts), pairs)


def near_copies() -> list:
    """A large group of near copies on either side of the threshold, of several lengths, and passages shared by documents that aren't alike."""
    rng = random.Random(3)
    base, boiler = soup(11, 150), soup(12, 60)
    out = [" ".join(edited(base, 100 + k, rng.randint(0, 6))) for k in range(40)]
    out += [" ".join(edited(base[: 150 - 3 * k], 200 + k, 1)) for k in range(12)]
    out += [" ".join(boiler + soup(300 + k, rng.randint(5, 40))) for k in range(20)]
    out += [" ".join(soup(400 + k, 4)) for k in range(4)] * 2
    return out


@pytest.mark.parametrize("texts", [corpus(), near_copies()], ids=["cases", "near copies"])
def test_jaccard_components(spark, texts):
    want, sets = brute_components(texts), [shingles(t) for t in texts]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setjoin.similar_components(table(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_jaccard_nulls_repeats_and_empty_tables(spark):
    got = setjoin.similar_components(with_nulls(spark, corpus())).collect()
    assert len(got) == len(corpus()) + 3
    assert {(r["n_shingles"] > 0, r["component_id"]) for r in got if r["doc_id"] is None} == {(True, None), (False, None)}
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert setjoin.similar_components(empty(spark)).count() == 0
    assert [tuple(r) for r in setjoin.similar_components(table(spark, [None, ""])).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 1)]


def test_lists_dealt_to_several_tasks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST", 4)
    monkeypatch.setattr(setjoin, "MEMBERS", 3)
    monkeypatch.setattr(setjoin, "PAIRS", 5)
    monkeypatch.setattr(setjoin, "TOGETHER", 10)
    texts = near_copies()
    want = brute_components(texts)
    got = {r["doc_id"]: r["component_id"] for r in setjoin.similar_components(table(spark, texts)).collect()}
    assert got == want


def test_an_id_with_several_texts_is_one_node_with_all_their_links(spark):
    one, two = soup(31, 200), soup(32, 200)
    texts = [" ".join(x) for x in (one, two, edited(one, 1, 1), edited(two, 2, 1), soup(33, 200))]
    df = spark.createDataFrame(list(zip((1, 1, 5, 6, 7), texts, strict=True)), "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["component_id"]) for r in setjoin.similar_components(df).collect()) == [(1, 1), (1, 1), (5, 1), (6, 1), (7, 7)]


def test_bitmaps_never_rule_out_sets_that_are_alike():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 65, 700, 40_000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.5, 1.0):
            other = np.unique(np.concatenate([s[rng.random(len(s)) >= share], rng.integers(0, 2**64, max(1, int(n * share)), dtype=np.uint64)]))
            apart = setjoin.differing(setjoin.parity(s), setjoin.parity(other))
            assert apart <= len(np.setxor1d(s, other))
        assert setjoin.differing(setjoin.parity(s), setjoin.parity(s)) == 0


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_a_list_are_those_that_sizes_and_places_allow(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(2, 260, 5) if seed % 2 else rng.integers(2, 60, 40)
    group = np.repeat(np.arange(len(sizes)), sizes)
    n = rng.integers(20, 60, len(group))
    order = np.lexsort((n, group))
    group, n = group[order], n[order]
    room = n - rng.integers(0, 12, len(n))
    cluster = rng.integers(0, 4, len(n))
    need = lambda i, j: -(-(n[i] + n[j]) * 80 // 180)
    ends = np.flatnonzero(np.append(group[1:] != group[:-1], True)) + 1
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        want = {(i, j) for i in range(a, b) for j in range(i + 1, b) if cluster[i] != cluster[j] and 100 * n[i] >= 80 * n[j] and min(room[i], room[j]) >= need(i, j)}
        found = [(x + a, y + a) for i, j in setjoin.list_pairs(np.arange(b - a), cluster[a:b], n[a:b], room[a:b], 80) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        assert {(min(x), max(x)) for x in found} == want and len(found) == len(want)
        if b - a <= setjoin.BLOCK:
            assert {(x, y) for i, j in setjoin.short_pairs(group[a:b], cluster[a:b], n[a:b], room[a:b], 80) for x, y in zip((i + a).tolist(), (j + a).tolist(), strict=True)} == want


def test_candidates_grow_with_the_group_not_its_square(spark, monkeypatch):
    """Near copies on either side of the threshold, and texts with one common line."""
    write, seen = setjoin.Scratch.write, {}

    def counted(self, df, name):
        out = write(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(setjoin.Scratch, "write", counted)
    figures = []
    for n in (200, 800):
        rng = random.Random(n)
        base, line = soup(41, 90), " ".join(soup(42, 12))
        texts = [" ".join(edited(base, 1000 + k, rng.randint(0, 9))) for k in range(n)] + [line + "\n" + " ".join(soup(5000 + k, 60)) for k in range(n)]
        got = {r["doc_id"]: r["component_id"] for r in setjoin.similar_components(table(spark, texts)).collect()}
        if n == 200:
            assert got == brute_components(texts)
        figures.append(sum(seen[k] for k in ("stars", "candidates", "leaders", "far") if k in seen))
    assert figures[1] < 8 * figures[0]  # the square would be 16


def test_pairs_of_copies_that_link_here_and_there_grow_no_faster_than_the_copies(spark, monkeypatch):
    """Copies of a text of 200 words, each with three words of its own: most pairs are just below the threshold."""
    write, seen = setjoin.Scratch.write, {}

    def counted(self, df, name):
        out = write(self, df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(setjoin.Scratch, "write", counted)
    figures = []
    for n in (300, 600, 1200):
        seen.clear()
        base = soup(61, 200)
        texts = []
        for k in range(n):
            words, rng = list(base), random.Random(9000 + k)
            for i in rng.sample(range(200), 3):
                words[i] = f"own{k}x{i}"
            texts.append(" ".join(words))
        got = {r["doc_id"]: r["component_id"] for r in setjoin.similar_components(table(spark, texts)).collect()}
        if n == 300:
            assert got == brute_components(texts)
        figures.append((seen["candidates"], sum(seen.get(k, 0) for k in ("stars", "near", "leaders", "ends", "far"))))
    assert all(b <= 2.5 * a for x, y in zip(figures, figures[1:], strict=False) for a, b in zip(x, y, strict=True)), figures


@pytest.mark.parametrize("seed", range(4))
def test_sets_of_a_cell_take_their_nearest_possible_partners(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 120 - k, replace=False), rng.integers(0, 1 << 63, int(k), dtype=np.uint64)])) for k in rng.integers(0, 30, 40)]
    n, bits, cluster = np.array([len(s) for s in sets]), [setjoin.parity(s) for s in sets], rng.integers(0, 12, 40)
    near = {}
    for i in range(40):
        able = [(setjoin.differing(bits[i], bits[j]), j) for j in range(40) if cluster[i] != cluster[j] and min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 80]
        near[i] = sorted((d, j) for d, j in able if d <= n[i] + n[j] - 2 * (-(-(n[i] + n[j]) * 80 // 180)))[: setjoin.NEAREST]
    assert setjoin.cell_pairs(cluster, n, bits, 80) == {(min(i, j), max(i, j)) for i in near for _, j in near[i]}


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(310, 350)] + [(400, 400)]
    want = roots(401, links)
    nodes = {x for e in links for x in e}
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(4)
    assert {r["node"]: r["component"] for r in components(df).collect()} == {x: want[x] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(texts: list, least: int = 3, near: int = 8) -> dict[int, set[int]]:
    first: dict[tuple, tuple] = {}
    seen = []
    for d, t in enumerate(texts):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = tuple(WORDS.findall(line))
            if len(w) >= least:
                first.setdefault(w, (d, k))
                seen.append((w, (d, k)))
    close = {w for w in first if len(w) >= near and any(len(v) >= near and first[v] < first[w] and linededup.within_one(list(v), list(w)) for v in first if v != w)}
    out = defaultdict(set)
    for w, (d, k) in seen:
        if w in close or first[w] != (d, k):
            out[d].add(k)
    return out


def lines_corpus() -> list:
    rng = random.Random(9)
    pool = [soup(500 + k, rng.randint(6, 20)) for k in range(12)]
    out = []
    for d in range(30):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(pool))
            kind = rng.random()
            if kind < 0.2:
                w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
            elif kind < 0.4:
                del w[rng.randrange(len(w))]
            elif kind < 0.6:
                w.insert(rng.randrange(len(w) + 1), f"y{rng.randrange(4)}")
            lines.append(rng.choice([" ", "  "]).join(w) if kind > 0.9 else " ".join(w))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("texts", [corpus(), lines_corpus()], ids=["cases", "edits"])
def test_line_dedup(spark, texts):
    drop = brute_lines(texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        r = got[d]
        assert r["n_dropped"] == len(drop[d])
        assert r["n_lines"] == (0 if t is None else t.count("\n") + 1)
        assert r["text"] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d]))
        assert r["score"] == "x"


def test_short_lines_lose_to_earlier_ones_in_the_query_and_the_pipeline(spark, tmp_path):
    texts = ["Read more\nOK\nSign up for news\n\n" + " ".join(soup(k, 15)) + "\nhome page is here now" for k in range(3)]
    texts += ["Sign up for updates\nOK\n" + " ".join(soup(9, 14)), "home page is over here now\nnot the same\nnot a same\nRead less", "Read more", *lines_corpus()]
    drop = brute_lines(texts, 1, 4)
    table(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d]) for d, t in enumerate(texts)}
    assert {d: r["text"] for d, r in got.items()} == want
    kept = corpus_pipeline.line_stage(spark, table(spark, texts), str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {d: t for d, t in want.items() if t.strip() or not drop[d]}


def test_other_blanks_than_ascii_ones_are_letters(spark):
    """U+00A0 and the like don't cut words: not in the variants, and not where an edit is verified."""
    for blank in "\u00a0\u3000\u0085\u001c\u001f":
        words = soup(55, 12)
        one, two, three = (" ".join([*words[:5], x, *words[6:]]) for x in (f"a{blank}b", "two", "three"))
        texts = [one, two, three]
        got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(table(spark, texts)).collect()}
        assert got == {0: 0, 1: 1, 2: 1} and {d: len(x) for d, x in brute_lines(texts).items()} == {1: 1, 2: 1}


def test_hot_lines_meet_their_occurrences(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 3)
    texts = ["Read more\n" + " ".join(soup(k % 7, 15)) for k in range(30)] + lines_corpus()
    drop = brute_lines(texts, 1, 4)
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.dedup_lines(table(spark, texts), 1, 4).collect()}
    assert got == {d: len(drop[d]) for d in range(len(texts))}


def test_line_dedup_nulls_and_empty_tables(spark):
    got = linededup.dedup_lines(with_nulls(spark, corpus())).collect()
    assert len(got) == len(corpus()) + 3
    assert sorted(str(r["text"]) for r in got if r["doc_id"] is None) == sorted([corpus()[0], "None"])
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_within_one():
    assert linededup.within_one(["a", "b"], ["a", "c"]) and linededup.within_one(["a"], []) and linededup.within_one(["a", "b"], ["b"])
    assert not linededup.within_one(["a", "b"], ["c", "d"]) and not linededup.within_one(["a", "b", "c"], ["a"])


def test_shared_passages_are_found(spark):
    passage, short = soup(31, 70), soup(32, 30)
    texts = [" ".join(soup(600 + k, 60) + passage + soup(700 + k, 50)) for k in range(5)]
    texts += [" ".join(soup(800, 80) + edited(passage, 1, 3) + soup(801, 40)), " ".join(soup(802, 90) + short), " ".join(short + soup(803, 90)), " ".join(soup(804, 200))]
    texts += [None, "", " ".join(["De"] * 300), " ".join(soup(805, 30) + passage[:49]), " ".join(soup(806, 300)), " ".join(soup(806, 300))]
    out = substring.repeated_passages(table(spark, texts)).collect()
    found = defaultdict(list)
    for r in out:
        a, b = (WORDS.findall(fold(texts[r[x]])) for x in ("doc_id", "other_id"))
        assert r["stop"] - r["start"] >= 50 and r["doc_id"] != r["other_id"]
        assert sum((Counter(a[r["start"] : r["stop"]]) & Counter(b[r["other_start"] : r["other_stop"]])).values()) >= r["matched"] >= 0.8 * (r["stop"] - r["start"])
        found[r["doc_id"]].append((r["start"], r["stop"]))
    assert set(found) == {0, 1, 2, 3, 4, 5, 13, 14}
    for k in range(5):
        assert any(s <= 60 and e >= 130 for s, e in found[k])
    assert found[14] == [(0, 300)]
    assert substring.repeated_passages(empty(spark)).count() == 0
    assert substring.repeated_passages(with_nulls(spark, texts)).select("doc_id").where("doc_id is null").count() == 0


def test_maximal_parts():
    import numpy as np

    rng = random.Random(3)
    for _ in range(80):
        x = np.array([rng.choice([1.0, -4.0, 1.0, 1.0]) for _ in range(30)])
        parts = substring.maximal(x)
        best = max([0.0, *(x[i:j].sum() for i in range(30) for j in range(i + 1, 31))])
        assert max([0.0, *(x[s:e].sum() for s, e in parts)]) == best
        assert all(x[s:e].sum() > 0 for s, e in parts) and all(a[1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_chains_are_the_best_ones():
    rng = random.Random(2)
    for _ in range(60):
        p = sorted(rng.sample(range(200), 7))
        q, n = [rng.randrange(200) for _ in p], [rng.randint(3, 12) for _ in p]
        score = [0.0] * 7
        for i in range(7):
            score[i] = float(n[i])
            for j in range(i):
                if p[j] + n[j] <= p[i] and q[j] + n[j] <= q[i]:
                    gap = substring.GAP_COST * (p[i] - p[j] - n[j] + q[i] - q[j] - n[j])
                    score[i] = max(score[i], n[i] + score[j] - gap)
        best = substring.chains(p, q, n, 0)[0]
        got = sum(n[i] for i in best) - sum(substring.GAP_COST * (p[b] - p[a] - n[a] + q[b] - q[a] - n[a]) for a, b in zip(best, best[1:], strict=False))
        assert got == pytest.approx(max(score))
    assert len(rows(["a"])) == 1


def passages_found(spark, texts: list) -> dict[int, set[int]]:
    """For each document the words of the passages reported."""
    out = defaultdict(set)
    for r in substring.repeated_passages(table(spark, texts)).collect():
        out[r["doc_id"]] |= set(range(r["start"], r["stop"]))
    return out


@pytest.mark.parametrize("every", [5, 6, 8, 12, 20])
def test_passages_with_a_word_replaced_every_few_are_found(spark, every):
    texts = []
    for k, n in enumerate([55, 60, 100, 200] * 3):
        words = [f"p{k}x{j}" for j in range(n)]
        other = [f"q{k}x{j}" if j % every == k % every else w for j, w in enumerate(words)]
        texts += [" ".join([f"a{k}x{j}" for j in range(40)] + words + [f"b{k}x{j}" for j in range(30)]), " ".join([f"c{k}x{j}" for j in range(25)] + other + [f"d{k}x{j}" for j in range(45)])]
    found = passages_found(spark, texts)
    for k, n in enumerate([55, 60, 100, 200] * 3):
        assert len(found[2 * k] & set(range(40, 40 + n))) >= 50
        assert len(found[2 * k + 1] & set(range(25, 25 + n))) >= 50


def test_random_edits_at_every_identity_are_found(spark):
    rng = random.Random(8)
    texts = []
    for k in range(40):
        words = [f"p{k}x{j}" for j in range(80)]
        other = list(words)
        for j in sorted(rng.sample(range(1, 79), 4 * (1 + k % 4)), reverse=True):
            other[j : j + 1] = rng.choice([[f"q{k}x{j}"], [f"q{k}x{j}"], []] if k % 2 else [[f"q{k}x{j}"]])
        texts += [" ".join([f"a{k}x{j}" for j in range(40)] + words), " ".join(other + [f"d{k}x{j}" for j in range(45)])]
    found = passages_found(spark, texts)
    assert all(len(found[2 * k] & set(range(40, 120))) >= 50 for k in range(40))


def test_an_exact_passage_is_found_though_very_many_hold_a_fragment_of_it(spark):
    passage = [f"p{j}" for j in range(60)]
    texts = [" ".join(passage[a : a + 30] + [f"x{k}a{a}y{j}" for j in range(40)]) for k in range(20) for a in (0, 10, 20, 30)]
    held = [" ".join([f"u{k}y{j}" for j in range(20)] + passage + [f"v{k}y{j}" for j in range(20)]) for k in range(3)]
    texts = texts[:40] + held + texts[40:]
    found = passages_found(spark, texts)
    assert set(found) == {40, 41, 42}
    assert all(found[k] >= set(range(20, 80)) for k in found)
