"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two interpolated Kneser-Ney models, of toxic and of ordinary labelled texts, give each word a
log-likelihood ratio. The lowest orders are shared counts of both classes, so that rare expressions are
smoothed alike. A text's features are its length-normalised ratio over all words and over the most toxic
run of words (which is how expressions of several words count); a logistic curve, fitted on labelled texts that the
models haven't seen, makes them a score.

Counts are kept by 64-bit keys of the n-grams themselves, in a table that grows with the corpus; the models are
made of it by joins and groupings. Up to ``MODEL_ROWS`` n-grams go to the tasks, and words are scored there; beyond,
the distinct words are scored by joins, and texts take their words' ratios by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .quality import held_out
from .stages import Scratch, sieved, written

U64 = np.uint64
#: Highest order, and the orders up to which counts are shared by the classes.
ORDER, SHARED = 6, 2
DISCOUNT = 0.75
#: n-grams that are broadcast: 130 MB.
MODEL_ROWS = 4_000_000
#: Words whose ratios a task keeps.
CACHE = 1_000_000
#: Words of a run over which the ratio is normalised.
RUN = 3
#: Bytes of text whose words are scored together: about 50 MB of arrays.
SLICE = K.CHUNK
_MULT = U64(0x9E3779B97F4A7C15)


class Letters:
    """The bytes of words, one after another, each word between marks; n-gram hashes at each place of a word after its first mark."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        length = ends - starts + 2
        self.first = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        self.bytes = np.full(int(self.first[-1]), 1, dtype=np.uint64)  # 1: the mark
        inner = np.arange(int(self.first[-1])) - np.repeat(self.first[:-1], length)
        word = np.repeat(np.arange(len(starts)), length)
        letter = (inner > 0) & (inner < length[word] - 1)
        self.bytes[letter] = K._LOWER[buf[(starts[word] + inner - 1)[letter]]]
        self.depth = inner  # letters before this one, the mark among them
        self.events = np.flatnonzero(inner > 0)
        self.word = word[self.events]

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: places in ``events`` that have one, and keys of n-gram and context."""
        context = np.zeros(len(self.events), dtype=np.uint64)
        depth = self.depth[self.events]
        own = self.bytes[self.events]
        for n in range(1, ORDER + 1):
            if n > 1:
                back = self.events - (n - 1)
                context = context * U64(257) + np.where(depth >= n - 1, self.bytes[np.maximum(back, 0)], 0) + U64(1)
            h = K.mix64(context * _MULT + own * U64(0xC2B2AE3D27D4EB4F) + U64(n))
            ok = np.flatnonzero(depth >= n - 1)
            yield n, ok, h[ok], K.mix64(context[ok] + U64(n << 32))


@dataclass
class Model:
    """Sorted keys of n-grams with their discounted shares, and of contexts with what goes to the next order, of (toxic, ordinary)."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    back: np.ndarray

    def ratios(self, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratio and number of events of each word."""
        p = np.full((len(letters.events), 2), 1 / 256)
        for _, ok, gram, context in letters.grams():
            p[ok] = _found(self.grams, self.share, gram, 0.0) + _found(self.contexts, self.back, context, 1.0) * p[ok]
        ratio = np.log(p[:, 0]) - np.log(p[:, 1])
        n = len(letters.first) - 1
        return np.bincount(letters.word, ratio, n), np.diff(letters.first) - 1


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    """The values of the wanted keys, ``other`` for those that aren't there."""
    if not len(keys):
        return np.full((len(wanted), 2), other)
    distinct, inverse = np.unique(wanted, return_inverse=True)
    at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
    return np.where((keys[at] == distinct)[:, None], values[at], other)[inverse]


COUNTS = "n int, gram long, context long, suffix long, head boolean, toxic long, ordinary long"


def _word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(word, toxic, ordinary)``: occurrences in the labelled texts of either class, over all of them."""
    rows = sieved(docs, labels, "doc_id").join(labels, "doc_id").select("text", "y")  # texts without a label aren't shuffled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(0))
            y = batch.column(1).to_numpy()
            for i, j in K.slices(off, SLICE):
                part = buf[off[i] : off[j]]
                w = K.words(part, off[i : j + 1] - off[i], sep=K.NOT_ALNUM)
                toxic = y[i:j][K.owner(w.first)].astype(np.int64)
                _, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
                t = np.bincount(inverse, toxic, len(at)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(at))
                text = K._LOWER[part]
                words = [text[a:b].tobytes() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(t), pa.array(n - t)], names=["word", "toxic", "ordinary"])

    return rows.mapInArrow(run, "word binary, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _letters(column: pa.Array) -> Letters:
    """Of a column of words."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return Letters(np.frombuffer(data, dtype=np.uint8), off[:-1], off[1:])


def _gram_counts(words: DataFrame) -> DataFrame:
    """Counts of all n-grams over the words, weighted by occurrences; ``suffix``: the n-gram without its first letter, ``head``: it begins a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = _letters(batch.column(0))
            weights = [batch.column(k).to_numpy()[letters.word] for k in (1, 2)]
            lower = np.zeros(len(letters.events), dtype=np.uint64)
            for n, ok, gram, context in letters.grams():
                full = np.zeros(len(letters.events), dtype=np.uint64)
                full[ok] = gram
                keys, at, inverse = np.unique(gram, return_index=True, return_inverse=True)
                head = letters.depth[letters.events[ok[at]]] == n - 1
                sums = [np.bincount(inverse, x[ok], len(keys)).astype(np.int64) for x in weights]
                longs = [pa.array(K.signed(np.ascontiguousarray(x))) for x in (keys, context[at], lower[ok][at])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), *longs, pa.array(head), *map(pa.array, sums)], names=[c.split()[0] for c in COUNTS.split(", ")])
                lower = full

    rows = words.mapInArrow(run, COUNTS)
    return rows.groupBy("gram").agg(*(F.min(c).alias(c) for c in ("n", "context", "suffix")), F.max("head").alias("head"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def models(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The models of ``docs`` (doc_id, text) labelled by ``labels`` (doc_id, y), as two written tables.

    ``(gram, toxic, ordinary)``: each n-gram's discounted share of its context, and ``(context, toxic, ordinary)``: what a
    context hands to the next lower order. Below the highest order an n-gram counts the longer ones that end so,
    but for a word's first ones, which have none and keep theirs. Orders up to ``SHARED`` add both classes up.
    """
    tables = Scratch(docs.sparkSession)
    counts = tables.write(_gram_counts(_word_counts(docs, labels)), "grams")
    follow = counts.where("n > 1").groupBy(F.col("suffix").alias("gram")).agg(*(F.count_if(F.col(c) > 0).alias(f"{c}_follow") for c in ("toxic", "ordinary")))
    keep = F.col("head") | (F.col("n") == ORDER)
    own = {c: F.when(keep, F.col(c)).otherwise(F.coalesce(f"{c}_follow", F.lit(0))) for c in ("toxic", "ordinary")}
    used = {c: F.when(F.col("n") <= SHARED, own["toxic"] + own["ordinary"]).otherwise(own[c]).alias(c) for c in own}
    rows = tables.write(counts.join(follow, "gram", "left").select("gram", "context", *used.values()), "continuations")
    sums = [F.sum(c).alias(f"{c}_total") for c in own] + [F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in own]
    contexts = rows.groupBy("context").agg(*sums)
    share = lambda c: (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1))).alias(c)
    back = lambda c: F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0).alias(c)
    shares = written(rows.join(contexts, "context").select("gram", share("toxic"), share("ordinary")).where("toxic > 0 or ordinary > 0"), "shares")
    backs = written(contexts.select("context", back("toxic"), back("ordinary")), "backs")
    tables.drop(counts, rows)
    return shares, backs


def gathered(shares: DataFrame, backs: DataFrame) -> Model:
    """The models as arrays; their rows are checked to be few enough before."""
    arrays = []
    for table, key in ((shares, "gram"), (backs, "context")):
        rows = table.toArrow()
        keys = rows[key].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        arrays += [keys[order], np.stack([rows[c].to_numpy() for c in ("toxic", "ordinary")], axis=1)[order]]
    return Model(*arrays)


FEATURES = "doc_id long, whole double, run double, word double, size double"


def feature_table(docs: DataFrame, shares: DataFrame, backs: DataFrame) -> DataFrame:
    """Length-normalised ratios of every text: over all its words, its most toxic run, and its most toxic word; and its log words. 0 for texts without words."""
    if shares.count() + backs.count() > MODEL_ROWS:
        return _joined_features(docs, _word_ratios(docs, shares, backs))
    shared = docs.sparkSession.sparkContext.broadcast(gathered(shares, backs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = np.zeros(0, np.uint64), np.zeros((2, 0))
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off, SLICE):
                part = buf[off[i] : off[j]]
                w = K.words(part, off[i : j + 1] - off[i], sep=K.NOT_ALNUM)
                out = np.zeros((4, j - i))
                n = np.diff(w.first)
                full = n > 0
                if full.any():
                    hashes, at, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
                    place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                    old = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                    scores = np.zeros((2, len(hashes)))
                    scores[:, old] = values[:, place[old]]
                    scores[:, ~old] = shared.value.ratios(Letters(part, w.starts[at[~old]], w.ends[at[~old]]))
                    if len(known) < CACHE and not old.all():
                        known, values = np.append(known, hashes[~old]), np.append(values, scores[:, ~old], axis=1)
                        order = np.argsort(known)
                        known, values = known[order], values[:, order]
                    ratio, events = scores[:, inverse]
                    sums, lengths = (np.concatenate([[0], np.cumsum(x)]) for x in (ratio, events))
                    first, last = w.first[:-1][full], w.first[1:][full]
                    stop = np.minimum(np.arange(len(ratio)) + RUN, np.repeat(last, n[full]))
                    begin = np.arange(len(ratio))
                    out[0, full] = (sums[last] - sums[first]) / (lengths[last] - lengths[first])
                    out[1, full] = np.maximum.reduceat((sums[stop] - sums[begin]) / (lengths[stop] - lengths[begin]), first)
                    out[2, full] = np.maximum.reduceat(ratio / events, first)
                    out[3] = np.log1p(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, out)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return docs.mapInArrow(run, FEATURES)


def _word_ratios(docs: DataFrame, shares: DataFrame, backs: DataFrame) -> DataFrame:
    """``(h, ratio, events)`` of every distinct word of the texts, by joins of its n-grams with the models."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off, SLICE):
                part = buf[off[i] : off[j]]
                w = K.words(part, off[i : j + 1] - off[i], sep=K.NOT_ALNUM)
                h, at = np.unique(w.hashes, return_index=True)
                text = K._LOWER[part]
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(h)), pa.array([text[a:b].tobytes() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)], pa.binary())], names=["h", "word"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            letters = _letters(batch.column(1))
            h = batch.column(0).to_numpy()[letters.word]
            for n, ok, gram, context in letters.grams():
                yield pa.RecordBatch.from_arrays([pa.array(h[ok]), pa.array(letters.depth[letters.events[ok]].astype(np.int32)), pa.array(np.full(len(ok), n, np.int32)), pa.array(K.signed(gram)), pa.array(K.signed(context))], names=["h", "at", "n", "gram", "context"])

    distinct = docs.select("doc_id", "text").mapInArrow(words, "h long, word binary").groupBy("h").agg(F.min("word").alias("word"))
    rows = distinct.mapInArrow(grams, "h long, at int, n int, gram long, context long")
    rows = rows.join(shares.toDF("gram", "st", "so"), "gram", "left").join(backs.toDF("context", "bt", "bo"), "context", "left")
    orders = F.sort_array(F.collect_list(F.struct("n", F.coalesce("st", F.lit(0.0)).alias("st"), F.coalesce("so", F.lit(0.0)).alias("so"), F.coalesce("bt", F.lit(1.0)).alias("bt"), F.coalesce("bo", F.lit(1.0)).alias("bo"))))
    p = lambda s, b: F.aggregate("orders", F.lit(1 / 256), lambda low, x: x[s] + x[b] * low)
    letters = rows.groupBy("h", "at").agg(orders.alias("orders")).select("h", (F.log(p("st", "bt")) - F.log(p("so", "bo"))).alias("ratio"))
    return letters.groupBy("h").agg(F.sum("ratio").alias("ratio"), F.count("*").alias("events"))


def _joined_features(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """The features by a join of every text's words with their ratios."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off, SLICE):
                w = K.words(buf[off[i] : off[j]], off[i : j + 1] - off[i], sep=K.NOT_ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(K.signed(w.hashes)))], names=["doc_id", "words"])

    rows = written(docs.select("doc_id", "text").mapInArrow(words, "doc_id long, words array<long>").withColumn("row", F.monotonically_increasing_id()), "words")
    met = rows.select("row", F.posexplode("words").alias("at", "h")).join(ratios, "h")
    lists = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "ratio", "events"))).alias("w"))
    total = lambda part, c: F.aggregate(part, F.lit(0.0), lambda x, y: x + y[c])
    over = lambda part: total(part, "ratio") / total(part, "events")
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: over(F.slice("w", i, RUN))))
    scored = lists.select("row", over(F.col("w")).alias("whole"), best.alias("run"), F.array_max(F.transform("w", lambda x: x["ratio"] / x["events"])).alias("word"), F.log1p(F.size("w")).alias("size"))
    return rows.select("row", "doc_id").join(scored, "row", "left").select("doc_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("whole", "run", "word", "size")))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the intercept first, by Newton's method with a ridge on standardised columns."""
    mean, std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-3, *[ridge] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
    return np.append(w[0] - (w[1:] * mean / std).sum(), w[1:] / std)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4, remainder: int = 2, max_rows: int = 100_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs`` (doc_id, text); labels of held-out rows aren't learned.

    The models count all labelled texts of the other remainders but the last; on that one the logistic
    curve is fitted, from at most about ``max_rows`` rows drawn by a hash of the id. Null and empty texts
    have features 0. Null ids are scored but not learned from; of several labels of an id the largest
    counts; repeated rows and other columns do no harm. Without labels every score is a half.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held_out(modulus, remainder)
    tuned = held_out(modulus, (remainder + 1) % modulus)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y")).where(~held)
    table = written(feature_table(docs, *models(docs.where(~held & ~tuned), known.where(~tuned))), "toxicity")
    fit_on = known.where(tuned)
    share = max(1, -(-fit_on.count() // max_rows))
    names = ["whole", "run", "word", "size"]
    rows = table.join(fit_on.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), "doc_id").select(*names, "y").toArrow()
    weights = logistic(np.stack([rows[c].to_numpy() for c in names], axis=1), rows["y"].to_numpy().astype(np.float64))
    logit = sum((F.col(c) * F.lit(float(v)) for c, v in zip(names, weights[1:], strict=True)), F.lit(float(weights[0])))
    score = 1 / (1 + F.exp(-logit))
    return table.withColumn("score", score).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
