"""Benchmark decontamination: every training passage queries a BM25 index of test items by block-max WAND.

Items are the documents of the index, passages the queries. Scores are BM25 over the item's own score, so
1 means that the passage has all of the item's terms, and one threshold serves items of any length; items
longer than a passage are indexed in segments. What is above the threshold is verified on word n-grams of
the item's question and of its answer around the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .stages import written

#: Words of a passage, and from one passage to the next.
PASSAGE, STRIDE = 64, 32
#: Most words of an indexed segment: wherever it stands, a passage has most of it.
SEGMENT = 48
K1, B = 1.2, 0.75
BLOCK = 32
#: Share of a segment's score that its commonest terms, which find no candidates, may make.
REST = 0.2
#: Bytes of item text in one index; more items make more indexes, which the documents that one scan leaves query one after the other.
SHARD_BYTES = 8 << 20
#: log2 of the hashed terms whose bounds that scan takes.
BOUND_BITS = 22
#: Words in the n-grams of the verification.
GRAM = 3
_ANSWER = re.compile(r"(?:^|\n|\s)(?:answer|a)\s*:\s*", re.I)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at the last ``Answer:`` or ``A:``, else the last quarter of the words is the answer."""
    marks = list(_ANSWER.finditer(text))
    if marks and text[: marks[-1].start()].strip() and text[marks[-1].end() :].strip():
        return text[: marks[-1].start()], text[marks[-1].end() :]
    words = text.split()
    cut = len(words) - max(1, len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _hashes(texts: list[str]) -> list[np.ndarray]:
    buf, off = K.utf8(pa.array(texts, pa.string()))
    w = K.words(buf, off, sep=K.NOT_ALNUM)
    return [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def _grams(h: np.ndarray) -> np.ndarray:
    return K.windows(h, min(GRAM, len(h))) if len(h) else np.zeros(0, np.uint64)


@dataclass
class Index:
    """Postings by term: segments by number, their impacts, and each block's largest impact."""

    items: list
    sizes: list[int]
    question: list[np.ndarray]
    answer: list[np.ndarray]
    segment_item: list[int]
    terms: np.ndarray
    most: np.ndarray
    postings: list[tuple[list[int], list[float], list[float]]]
    rare: tuple[np.ndarray, np.ndarray, np.ndarray]
    rest: np.ndarray


def build(items: list[tuple], df: dict[int, int], n: int, mean: float) -> Index:
    """The index of ``(item_id, text)``; ``df``, ``n`` and ``mean`` (words of a segment) are those of all items."""
    split = [split_item(t) for _, t in items]
    words, question, answer = _hashes([t for _, t in items]), _hashes([q for q, _ in split]), _hashes([a for _, a in split])
    lists: dict[int, list[tuple[int, float]]] = {}
    segment_item = []
    for i, h in enumerate(words):
        for part in segments(h):
            terms, tf = np.unique(part, return_counts=True)
            idf = np.log1p((n - np.array([df[int(t)] for t in K.signed(terms)]) + 0.5) / (np.array([df[int(t)] for t in K.signed(terms)]) + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean))
            impact /= impact.sum()
            for t, x in zip(terms.tolist(), impact.tolist(), strict=True):
                lists.setdefault(t, []).append((len(segment_item), x))
            segment_item.append(i)
    terms = np.array(sorted(lists), dtype=np.uint64)
    postings = []
    for t in terms.tolist():
        at, x = zip(*lists[t], strict=True)
        postings.append((list(at), list(x), [max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)]))
    most = np.array([max(p[2]) for p in postings], dtype=np.float64)
    # each segment's terms, rarest first, up to all but REST of its score: what has none of them can't reach a threshold above REST
    own: list[list[tuple[int, float, int]]] = [[] for _ in segment_item]
    for k, (at, x, _) in enumerate(postings):
        for seg, v in zip(at, x, strict=True):
            own[seg].append((len(at), v, k))
    chosen: list[list[tuple[int, float]]] = [[] for _ in postings]
    rest = np.zeros(len(segment_item))
    for seg, parts in enumerate(own):
        left = 1.0
        for _, v, k in sorted(parts):
            if left <= REST:
                break
            chosen[k].append((seg, v))
            left -= v
        rest[seg] = max(left, 0.0)
    flat = [x for part in chosen for x in part]
    rare = np.cumsum([0, *map(len, chosen)]), np.array([x[0] for x in flat], dtype=np.int64), np.array([x[1] for x in flat])
    return Index([i for i, _ in items], [len(h) for h in words], [_grams(h) for h in question], [_grams(h) for h in answer], segment_item, terms, most, postings, rare, rest)


def segments(h: np.ndarray) -> list[np.ndarray]:
    """Near equal parts of at most ``SEGMENT`` words; none for no words."""
    k = -(-len(h) // SEGMENT)
    return np.array_split(h, k) if k else []


def wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """Segments whose score for the query terms (places in ``index.terms``) reaches the threshold."""
    end = len(index.segment_item)
    cursors = [[index.postings[t][0][0], 0, t] for t in query]
    out = []
    while True:
        cursors = sorted(c for c in cursors if c[0] < end)
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += index.most[c[2]]
            if total >= threshold:
                pivot = k
                break
        if pivot < 0:
            return out
        target = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
            pivot += 1
        bound, until = 0.0, end
        for c in cursors[: pivot + 1]:
            at, _, blocks = index.postings[c[2]]
            k = c[1]
            while (k // BLOCK + 1) * BLOCK < len(at) and at[min((k // BLOCK + 1) * BLOCK, len(at)) - 1] < target:
                k = (k // BLOCK + 1) * BLOCK
            last = at[min((k // BLOCK + 1) * BLOCK, len(at)) - 1]
            bound += blocks[k // BLOCK] if last >= target else 0.0
            until = min(until, last + 1 if last >= target else end)
        if bound < threshold:  # no segment up to the end of these blocks, or the next cursor, can reach it
            until = max(target + 1, min(until, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
            for c in cursors[: pivot + 1]:
                _advance(index, c, until, end)
        elif cursors[0][0] == target:
            score = sum(index.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
            if score >= threshold:
                out.append((target, score))
            for c in cursors[: pivot + 1]:
                _advance(index, c, target + 1, end)
        else:
            for c in cursors[:pivot]:
                _advance(index, c, target, end)


def _advance(index: Index, cursor: list[int], to: int, end: int) -> None:
    at = index.postings[cursor[2]][0]
    k = cursor[1]
    while k + BLOCK < len(at) and at[k + BLOCK] < to:
        k += BLOCK
    while k < len(at) and at[k] < to:
        k += 1
    cursor[0], cursor[1] = at[k] if k < len(at) else end, k


def matches(index: Index, buf: np.ndarray, off: np.ndarray, threshold: float, question: float, answer: float) -> list[tuple]:
    """``(document, item, start, stop, score, question_overlap, answer_overlap)``: the best verified passage for each document and item."""
    if threshold <= REST:
        raise ValueError(f"the threshold has to be over {REST}")
    w = K.words(buf, off, sep=K.NOT_ALNUM)
    h = w.hashes
    if not len(h) or not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = index.terms[at] == h
    n = np.diff(w.first)
    best: dict[tuple[int, int], tuple] = {}
    for d, k in _promising(index, at, known, n, threshold):
        s = int(w.first[d]) + STRIDE * k
        e = min(s + PASSAGE, int(w.first[d + 1]))
        query = np.unique(at[s:e][known[s:e]])
        for segment, score in wand(index, query.tolist(), threshold):
            item = index.segment_item[segment]
            if (d, item) in best and best[d, item][4] >= score:
                continue
            lo, hi = max(int(w.first[d]), s - index.sizes[item]), min(int(w.first[d + 1]), e + index.sizes[item])
            found = [_overlap(g, h[lo:hi]) for g in (index.question[item], index.answer[item])]
            if found[0] >= question and found[1] >= answer:
                best[d, item] = (d, item, s - int(w.first[d]), e - int(w.first[d]), score, *found)
    return list(best.values())


def _promising(index: Index, at: np.ndarray, known: np.ndarray, n: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(document, passage) pairs of which some segment's bound reaches the threshold: its rare terms there (each occurrence counts) and the rest of its score.

    A passage is two strides long, so sums over strides give those of all passages.
    """
    ptr, segment, impact = index.rare
    size = ptr[at + 1] - ptr[at]
    words = np.flatnonzero(known & (size > 0))
    if not len(words):
        return []
    strides = -(-n // STRIDE)
    base = np.cumsum(strides) - strides
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)[words]
    stride = base[doc] + (words - first[doc]) // STRIDE
    size = size[words]
    entry = np.repeat(ptr[at[words]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    count = len(index.rest)
    keys, inverse = np.unique(np.repeat(stride, size) * count + segment[entry], return_inverse=True)
    sums = np.bincount(inverse, impact[entry])
    follow = np.searchsorted(keys, keys + count)
    both = sums + np.where((follow < len(keys)) & (keys[np.minimum(follow, len(keys) - 1)] == keys + count), sums[np.minimum(follow, len(keys) - 1)], 0.0)
    bound = index.rest[keys % count]
    # a passage that begins at the key's stride, or at the one before it
    good = np.unique(np.concatenate([keys[both + bound >= threshold - 1e-9] // count, keys[sums + bound >= threshold - 1e-9] // count - 1]))
    good = good[good >= 0]
    doc = np.searchsorted(base, good, side="right") - 1
    place = good - base[doc]
    starts = np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1)
    return [(int(d), int(k)) for d, k in zip(doc, place, strict=True) if k < starts[d]]


def _overlap(grams: np.ndarray, h: np.ndarray) -> float:
    """The part of an item's n-grams that the words have; n is the item's words if they are fewer than ``GRAM``. No n-grams: all."""
    if not len(grams):
        return 1.0
    have = [K.windows(h, k) for k in range(1, GRAM + 1)]  # windows of another length never hash alike
    return float(np.isin(grams, np.concatenate(have)).mean())


@dataclass
class Bench:
    """The items of a benchmark in shards, and the statistics of all of them."""

    items: DataFrame
    shards: int
    segments: DataFrame
    df: DataFrame
    n: int
    mean: float

    def index(self, shard: int) -> Index:
        """The index of one shard, made on the driver of at most about ``SHARD_BYTES`` of text."""
        here = self.items.where(F.col("shard") == shard)
        own = self.segments.where(F.col("shard") == shard).select(F.explode("terms").alias("term")).distinct()
        table = self.df.join(own, "term", "left_semi").toArrow()
        counts = dict(zip(table["term"].to_pylist(), table["df"].to_pylist(), strict=True))
        return build(sorted((r["item"], r["text"]) for r in here.select("item", "text").collect()), counts, self.n, self.mean)

    def bounds(self) -> np.ndarray:
        """By hashed term, over 255 and rounded up, the most that it adds to any segment's score as one of its rare terms; 4 MB for any benchmark."""
        size = F.col("words")
        terms = self.segments.withColumn("segment", F.monotonically_increasing_id()).select("segment", "words", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
        rows = terms.select("segment", "words", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf")).join(self.df, "term")
        idf = F.log1p((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = rows.withColumn("raw", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * size / self.mean)))
        of = Window.partitionBy("segment")
        rows = rows.withColumn("impact", F.col("raw") / F.sum("raw").over(of))
        before = F.sum("impact").over(of.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
        # the others make at most REST, and a little less for rounding
        rare = rows.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("before") < 1 - REST + 0.05)
        best = rare.groupBy(F.shiftrightunsigned("term", 64 - BOUND_BITS).cast("int").alias("at")).agg(F.max("impact").alias("most")).toArrow()
        out = np.zeros(1 << BOUND_BITS, dtype=np.uint8)
        out[best["at"].to_numpy()] = np.minimum(np.ceil(best["most"].to_numpy() * 255), 255)
        return out


def bench(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Bench | None:
    """The benchmark's items in shards of about ``SHARD_BYTES``. Null ids and texts, and texts without words, are left out; None without items."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not size:
        return None

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64())
        for batch in batches:
            rows = [(shard, *np.unique(p, return_counts=True), len(p)) for shard, h in zip(batch.column(0).to_pylist(), _hashes(batch.column(1).to_pylist()), strict=True) for p in segments(h)]
            cols = [[r[0] for r in rows], [K.signed(r[1]) for r in rows], [r[2].astype(np.int32) for r in rows], [r[3] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "terms", "counts", "words"])

    shards = -(-size // SHARD_BYTES)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)).cast("int"))
    used = items.select("shard", "text").mapInArrow(terms, "shard int, terms array<long>, counts array<int>, words long")
    if shards > 1:
        items, used = written(items, "items"), written(used, "segments")
    n, mean = used.agg(F.count("*"), F.avg("words")).first()
    df = used.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return Bench(items, shards, used, written(df, "terms") if shards > 1 else df, n, mean) if n else None


FOUND = "doc_id long, item_id long, start int, stop int, score double, question_overlap double, answer_overlap double"


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """Contaminated documents of ``docs`` (doc_id, text): a row for each document and benchmark item (item_id, text) found in it.

    ``start`` to ``stop`` are the words of the passage that scores best among the verified ones, the first of equals.
    Null and empty texts contain nothing; rows with null or repeated ids are searched like any other. Other columns
    are left out. No benchmark items: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = bench(benchmark)
    if known is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    context = docs.sparkSession.sparkContext
    if known.shards == 1:
        return docs.mapInArrow(_finder(context.broadcast(known.index(0)), threshold, question, answer), FOUND)
    # one scan leaves the documents of which a passage may reach the threshold for any item; the shards' indexes see only these, one after the other
    left = written(_able(docs, context.broadcast(known.bounds()), threshold), "promising")
    out = None
    for shard in range(known.shards):
        index = context.broadcast(known.index(shard))
        rows = written(left.mapInArrow(_finder(index, threshold, question, answer), FOUND), "found")
        index.destroy()
        out = rows if out is None else out.unionByName(rows)
    return out


def _able(docs: DataFrame, bounds, threshold: float) -> DataFrame:
    """Documents with a passage whose rare terms' bounds and the rest reach the threshold."""
    if threshold <= REST:
        raise ValueError(f"the threshold has to be over {REST}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off):
                w = K.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], sep=K.NOT_ALNUM)
                worth = bounds.value[(w.hashes >> np.uint64(64 - BOUND_BITS)).astype(np.int64)].astype(np.int64)
                sums = np.concatenate([[0], np.cumsum(worth)])
                # every occurrence counts, and every place may begin a passage: more than the index will look at
                doc = K.owner(w.first)
                stop = np.minimum(np.arange(len(worth)) + PASSAGE, w.first[1:][doc])
                good = sums[stop] - sums[np.arange(len(worth))] >= 255 * (threshold - REST) - 1
                keep = np.zeros(j - i, dtype=bool)
                keep[doc[good]] = True
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _finder(index, threshold: float, question: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off):
                rows = matches(index.value, buf[off[i] : off[j]], off[i : j + 1] - off[i], threshold, question, answer)
                ids = batch.column(0).slice(i, j - i).take(pa.array([r[0] for r in rows], pa.int64()))
                items = [index.value.items[r[1]] for r in rows]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip([items, *([r[k] for r in rows] for k in range(2, 7))], types[1:], strict=True))], names=names)

    return run


def without(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found; null texts stay.

    With more than one shard of items, rows go whose text equals (by SHA-256) one in which an item is found.
    """
    known = bench(benchmark)
    if known is None:
        return docs
    if known.shards > 1:
        # texts take the place of ids: each is found by a number of its own
        texts = written(docs.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text")).distinct().withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text"), "texts")
        bad = texts.join(find(texts, benchmark, threshold, question, answer), "doc_id", "left_semi").select(F.sha2("text", 256).alias("_bad"))
        return docs.join(bad, F.sha2(F.col("text").cast("string"), 256) == F.col("_bad"), "left_anti")
    at = docs.columns.index("text")
    index = docs.sparkSession.sparkContext.broadcast(known.index(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            buf, off = K.utf8(batch.column(at))
            for i, j in K.slices(off):
                keep[[i + r[0] for r in matches(index.value, buf[off[i] : off[j]], off[i : j + 1] - off[i], threshold, question, answer)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
