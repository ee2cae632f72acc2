"""Decontamination, packing, and the two classifiers."""

import array
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, kernels, packing, quality, toxicity

from .common import corpus, empty, soup, table, with_nulls

BPE = public_tokenizers.path("byte_bpe_50k.json")
FOUND_KEYS = ("doc_id", "item_id")


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, doc_id string")


def test_leaks_are_found_and_clean_texts_are_not(spark):
    items = [(k, " ".join(soup(1000 + k, 20 + 9 * k)), "x") for k in range(12)] + [(90, "Question: " + " ".join(soup(1100, 12)) + " Answer: " + " ".join(soup(1101, 3)), None), (91, None, None), (92, "", None), (None, "a b c", None), (3, items_three := " ".join(soup(1003, 47)), "x")]
    assert items_three == items[3][1]
    texts, want = [], set()
    for k, (item, t, _) in enumerate(items[:13]):
        texts.append(" ".join(soup(1200 + k, 37 * k) + t.split() + soup(1300 + k, 25)).replace("the", "THE").replace("ing", "Ing") if k % 2 else " ".join(soup(1200 + k, 37 * k) + t.split()))
        want.add((k, item))
    clean = [" ".join(soup(1400 + k, 150)) for k in range(6)] + [None, "", " ".join(items[5][1].split()[:20] + soup(1500, 200)), " ".join(soup(1502, 5000))]
    got = decontaminate.find(table(spark, texts + clean), benchmark(spark, items)).collect()
    assert {tuple(r[k] for k in FOUND_KEYS) for r in got} == want
    kept = decontaminate.without(table(spark, texts + clean), benchmark(spark, items))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(texts), len(texts + clean)))
    assert kept.columns == table(spark, texts).columns
    assert decontaminate.find(empty(spark), benchmark(spark, items)).count() == 0
    assert decontaminate.find(table(spark, texts), benchmark(spark, [])).count() == 0
    assert decontaminate.without(with_nulls(spark, texts), benchmark(spark, items)).where("doc_id is null and text is null").count() == 1


def test_a_benchmark_of_many_shards_is_found_alike(spark, monkeypatch):
    items = [(k, " ".join(soup(1000 + k, 20 + 9 * k)), "x") for k in range(12)] + [(91, None, None), (92, "", None)]
    texts = [" ".join(soup(1200 + k, 37 * k) + items[k % 12][1].split() + soup(1300 + k, 25)) for k in range(16)] + [" ".join(soup(1400 + k, 150)) for k in range(6)] + [None, ""]
    docs, items = table(spark, texts), benchmark(spark, items)
    rounded = lambda rows: sorted((*r[:4], *(round(x, 9) for x in r[4:])) for r in rows)
    want = rounded(decontaminate.find(docs, items).collect())
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 900)
    assert decontaminate.bench(items).shards > 3
    found = rounded(decontaminate.find(docs, items).collect())
    assert found == want and {r[0] for r in found} == set(range(16))
    kept = decontaminate.without(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(16, 24)) and kept.columns == docs.columns


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for k in range(150)]
    hashed = decontaminate._hashes([t for _, t in items])
    df: dict[int, int] = {}
    for h in hashed:
        for t in kernels.signed(np.unique(h)).tolist():
            df[t] = df.get(t, 0) + 1
    index = decontaminate.build(items, df, len(items), float(np.mean([len(h) for h in hashed])))
    for _ in range(40):
        query = sorted(rng.sample(range(len(index.terms)), 25))
        scores = np.zeros(len(index.segment_item))
        for t in query:
            at, x, _ = index.postings[t]
            scores[at] += x
        for threshold in (0.3, 0.45, 0.6):
            got = dict(decontaminate.wand(index, query, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold).tolist())
            assert all(got[k] == pytest.approx(scores[k]) for k in got)


def test_promising_passages_miss_nothing():
    rng = random.Random(6)
    words = soup(1, 80)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 60)))) for k in range(40)]
    df: dict[int, int] = {}
    n = total = 0
    for h in decontaminate._hashes([t for _, t in items]):
        for part in decontaminate.segments(h):
            n, total = n + 1, total + len(part)
            for t in kernels.signed(np.unique(part)).tolist():
                df[t] = df.get(t, 0) + 1
    index = decontaminate.build(items, df, n, total / n)
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 3, 31, 32, 33, 64, 65, 96, 97, 200]))) for _ in range(60)]
    buf, off = kernels.utf8(pa.array(texts, pa.string()))
    w = kernels.words(buf, off, sep=kernels.NOT_ALNUM)
    at = np.minimum(np.searchsorted(index.terms, w.hashes), len(index.terms) - 1)
    known = index.terms[at] == w.hashes
    found = set(decontaminate._promising(index, at, known, np.diff(w.first), 0.4))
    for d in range(len(texts)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        for k, s in enumerate(range(a, max(b - decontaminate.PASSAGE + decontaminate.STRIDE, a + 1), decontaminate.STRIDE)):
            query = np.unique(at[s : min(s + decontaminate.PASSAGE, b)][known[s : min(s + decontaminate.PASSAGE, b)]])
            if len(query) and decontaminate.wand(index, query.tolist(), 0.4):
                assert (d, k) in found


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*corpus(), "a  b   c \n d\t e   f", "x <|endoftext|> y", "it's 12 o'clock\n\n\nü", "end "]
    exact = Tokenizer.from_file(BPE)
    got = packing.pack(with_nulls(spark, texts), BPE).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in enumerate(texts):
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        copies = 2 if d == 0 else 1
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])[::copies]
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at and zlib.crc32(array.array("I", ids[at : at + r["length"]]).tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in pieces[1:])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty(spark), BPE).count() == 0


def test_local_search_only_improves():
    rng = random.Random(8)
    for _ in range(30):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 120))]
        before = packing.best_fit(lengths, 100)
        after = packing.improve([list(b) for b in before], lengths, 100)
        assert sorted(i for b in after for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in after) and len(after) <= len(before)
    assert len(packing.improve([[0, 1], [2], [3]], [70, 20, 30, 75], 100)) == 2
    assert packing.improve([], [], 10) == []


def better_exchange(bins: list[list[int]], lengths: list[int], capacity: int) -> bool:
    """Whether some move, one-for-one or two-for-one exchange out of a sequence makes another, no emptier underfull one fuller."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, mine in enumerate(bins):
        for b, theirs in enumerate(bins):
            if a == b or not fill[a] <= fill[b] < capacity:
                continue
            groups = [(i,) for i in mine] + list(itertools.combinations(mine, 2))
            if any(fill[b] + lengths[i] <= capacity for i in mine):
                return True
            if any(lengths[j] < (x := sum(lengths[i] for i in g)) and fill[b] + x - lengths[j] <= capacity for g in groups for j in theirs):
                return True
    return False


def test_local_search_ends_where_nothing_can_be_exchanged():
    rng = random.Random(9)
    for k in range(40):
        lengths = [rng.randint(20, 70) if k % 2 else rng.choice([26, 27, 34, 51]) for _ in range(rng.randint(5, 60))]
        after = packing.improve(packing.best_fit(lengths, 100), lengths, 100)
        assert len(after) == -(-sum(lengths) // 100) or not better_exchange(after, lengths, 100)
    assert len(packing.improve(packing.best_fit([1025] * 3000, 2048), [1025] * 3000, 2048)) == 3000


def labelled(n: int = 400) -> tuple[list, list]:
    rng = random.Random(12)
    texts, labels = [], []
    for d in range(n):
        words = soup(2000 + d, rng.randint(10, 60))
        toxic, good = rng.random() < 0.25, rng.random() < 0.8
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grimblax", "Zorkwit", "vequzzle"]))
        if not good:
            words = [w for w in words[:6] for _ in range(9)] + (["grimblax"] if toxic else [])
        texts.append(" ".join(words))
        labels.append((d, int(good), int(toxic), "x"))
    return texts, labels


def labels_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality(spark):
    texts, labels = labelled()
    odd = [(None, 1, 1, None), (5, None, None, None), (10**6, 1, 0, None)]
    got = quality.classify(table(spark, [*texts, None, ""]), labels_table(spark, labels + odd)).collect()
    assert len(got) == len(texts) + 2
    held = [r for r in got if r["held_out"] and r["doc_id"] < len(labels)]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.95 * len(held)
    assert quality.classify(empty(spark), labels_table(spark, labels)).count() == 0
    assert {r["score"] for r in quality.classify(with_nulls(spark, texts[:5]), labels_table(spark, [])).collect()} == {0.5}
    kept = quality.accepted(table(spark, texts), labels_table(spark, labels))
    assert kept.columns == table(spark, texts).columns and 0 < kept.count() < len(texts)


def test_held_out_labels_are_not_learned(spark):
    texts, labels = labelled(200)
    flipped = [(d, 1 - q, 1 - t, x) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, q, t, x) for d, q, t, x in labels]
    a, b = ({r["doc_id"]: r["score"] for r in quality.classify(table(spark, texts), labels_table(spark, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity(spark):
    texts, labels = labelled()
    got = toxicity.classify(with_nulls(spark, texts), labels_table(spark, labels + [(None, 1, 1, None), (7, None, None, None)])).collect()
    assert len(got) == len(texts) + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == labels[r["doc_id"]][2] for r in held) >= 0.95 * len(held)
    assert toxicity.classify(empty(spark), labels_table(spark, labels)).count() == 0
    assert {r["score"] for r in toxicity.classify(table(spark, ["a b", None]), labels_table(spark, [])).collect()} == {0.5}


def plain_kneser_ney(texts: list, toxic: list) -> dict[bytes, float]:
    """Log-likelihood ratio of every word by counts in dictionaries."""
    counts: list[Counter] = [Counter(), Counter()]
    words = set()
    for text, y in zip(texts, toxic, strict=True):
        for word in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode()):
            word = word.lower()
            words.add(word)
            letters = (1, *word, 1)
            for i in range(1, len(letters)):
                for n in range(1, min(toxicity.ORDER, i + 1) + 1):
                    counts[y][letters[i - n + 1 : i + 1], i == n - 1] += 1  # an n-gram that begins with the first mark begins the word
    used: list[dict] = [{}, {}]
    for gram, head in set(counts[0]) | set(counts[1]):
        for y in (0, 1):
            longer = {g for (g, _), c in counts[y].items() if c and len(g) == len(gram) + 1 and g[1:] == gram} if len(gram) < toxicity.ORDER and not head else ()
            used[y][gram, head] = counts[y][gram, head] if head or len(gram) == toxicity.ORDER else len(longer)
    share, back = [{}, {}], [{}, {}]
    for y in (0, 1):
        mine = {g: c + used[1 - y][g] if len(g[0]) <= toxicity.SHARED else c for g, c in used[y].items()}
        total, kinds = Counter(), Counter()
        for (gram, _), c in mine.items():
            total[gram[:-1]] += c
            kinds[gram[:-1]] += c > 0
        share[y] = {gram: max(c - toxicity.DISCOUNT, 0) / max(total[gram[:-1]], 1) for (gram, _), c in mine.items()}
        back[y] = {g: toxicity.DISCOUNT * kinds[g] / t for g, t in total.items() if t}
    out = {}
    for word in words:
        letters, ratio = (1, *word, 1), 0.0
        for i in range(1, len(letters)):
            p = [1 / 256, 1 / 256]
            for n in range(1, min(toxicity.ORDER, i + 1) + 1):
                gram = letters[i - n + 1 : i + 1]
                p = [share[y].get(gram, 0.0) + back[y].get(gram[:-1], 1.0) * p[y] for y in (0, 1)]
            ratio += np.log(p[1]) - np.log(p[0])
        out[word] = ratio
    return out


def test_ratios_are_those_of_plain_kneser_ney_counts(spark):
    texts, labels = labelled(24)
    texts = [" ".join(t.split()[:12]) if t else t for t in texts]
    docs = table(spark, texts).select("doc_id", "text")
    model = toxicity.gathered(*toxicity.models(docs, labels_table(spark, labels).select("doc_id", F.col("toxic").alias("y"))))
    known = [(t, y) for t, (_, _, y, _) in zip(texts, labels, strict=True) if t]
    want = plain_kneser_ney(*zip(*known, strict=True))
    words = sorted(want)
    off = np.cumsum([0, *map(len, words)])
    ratio, events = model.ratios(toxicity.Letters(np.frombuffer(b"".join(words), np.uint8), off[:-1], off[1:]))
    assert ratio.tolist() == pytest.approx([want[w] for w in words])
    assert events.tolist() == [len(w) + 1 for w in words]


def test_features_are_the_same_by_joins(spark, monkeypatch):
    texts, labels = labelled(40)
    docs = table(spark, [*texts, None, "", "One."]).select("doc_id", "text")
    tables = toxicity.models(docs, labels_table(spark, labels).select("doc_id", F.col("toxic").alias("y")))
    here = {r["doc_id"]: r for r in toxicity.feature_table(docs, *tables).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    there = {r["doc_id"]: r for r in toxicity.feature_table(docs, *tables).collect()}
    assert len(here) == docs.count() and set(here) == set(there)
    for d, r in here.items():
        assert list(there[d])[1:] == pytest.approx(list(r)[1:])


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, rounds=30, pairs=2)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    assert set(model.pairs[0][:2]) == {0, 1}
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
