"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, learned by cyclic boosting of trees with two
splits; the strongest pairs of features then get tables of their own. A score is the logistic of a sum of
table entries, so scoring is a few vectorised additions a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

FEATURES = (
    "log_words", "mean_word", "std_word", "longest_word", "distinct", "top_share", "adjacent", "trigrams", "short_words", "symbol_words", "mixed_words",
    "sentence_ends", "commas", "digits", "capitals", "symbols", "other_bytes", "words_per_line",
)

_CLASS = np.zeros(256, dtype=np.uint8)  # of bytes: 0 other, 1 digit, 2 capital, 3 symbol, 4 blank, 5 beyond ASCII
_CLASS[[*range(48, 58)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
_CLASS[[0x20, *range(9, 14)]] = 4
_CLASS[128:] = 5


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; all 0 for a text without words."""
    w = K.words(buf, off)
    n = np.diff(w.first)
    out = np.zeros((len(n), len(FEATURES)))
    size = np.maximum(np.diff(off), 1)
    kind = _CLASS[buf]
    per_class = []
    for c in (1, 2, 3, 5):
        sums = np.concatenate([[0], np.cumsum(kind == c)])
        per_class.append((sums[off[1:]] - sums[off[:-1]]) / size)
    feeds = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    lines = feeds[off[1:]] - feeds[off[:-1]] + 1
    full = n > 0
    at, m = w.first[:-1][full], n[full]
    if not len(at):
        return out
    length = w.ends - w.starts
    last = buf[w.ends - 1] if len(w.ends) else buf[:0]
    symbol = np.concatenate([[0], np.cumsum(kind == 3)])
    marks = symbol[w.ends] - symbol[w.starts]
    mean = lambda x: np.add.reduceat(x.astype(np.float64), at) / m
    mean_length = mean(length)
    same = np.zeros(len(w.hashes), dtype=bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[at] = False
    grams = K.windows(w.hashes, 3)
    distinct, top, trigrams = np.zeros(len(m)), np.zeros(len(m)), np.ones(len(m))
    for k, (a, c) in enumerate(zip(at.tolist(), m.tolist(), strict=True)):
        h = np.sort(w.hashes[a : a + c])
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        distinct[k] = len(edge) / c
        top[k] = np.diff(np.append(edge, c)).max() / c
        if c >= 3:
            g = np.sort(grams[a : a + c - 2])
            trigrams[k] = (1 + np.count_nonzero(g[1:] != g[:-1])) / (c - 2)
    columns = (
        np.log1p(m), mean_length, np.sqrt(np.maximum(mean(length.astype(np.float64) ** 2) - mean_length**2, 0)), np.log1p(np.maximum.reduceat(length, at)), distinct, top, mean(same), trigrams,
        mean(length <= 3), mean(marks == length), mean((marks >= 3) & (marks < length)), mean(np.isin(last, [0x2E, 0x21, 0x3F])), mean(last == 0x2C), *(c[full] for c in per_class), m / lines[full],
    )
    out[full] = np.stack(columns, axis=1)
    return out


@dataclass
class Additive:
    """Bin edges and tables of single features and of pairs; a feature value v falls in bin searchsorted(edges, v, right)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher"))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, rows: np.ndarray, least: int) -> np.ndarray:
    """Values by bin of the best tree with up to two splits, by gradient and curvature sums of the bins."""
    n = len(g)
    cuts = [0, n]
    for _ in range(2):
        best = (1e-6, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            cg, ch, cr = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(rows[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain[(cr[:-1] < least) | (cr[-1] - cr[:-1] < least)] = 0
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), a + k + 1))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(n)
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four parts."""
    cg, ch = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    a, b = (np.stack([c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1]]) for c in (cg, ch))
    if not a.size:
        return 0.0, np.zeros_like(g)
    gain = (a**2 / (b + 1)).sum(0)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    leaf = _leaf(a[:, i, j], b[:, i, j])
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]) - float(cg[-1, -1] ** 2 / (ch[-1, -1] + 1)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 150, rate: float = 0.15, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40, least: int = 10) -> Additive:
    """Cyclic boosting on rows ``x`` with labels ``y``; no rows: a model that gives a half, one class: its smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    at = []
    for j in range(x.shape[1]):
        model.edges.append(_edges(x[:, j], bins))
        at.append(np.searchsorted(model.edges[j], x[:, j], side="right"))
        model.tables.append(np.zeros(len(model.edges[j]) + 1))
    logit = np.full(len(y), model.intercept)
    counts = [np.bincount(a, minlength=len(t)) for a, t in zip(at, model.tables, strict=True)]
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-logit))
            n = len(table)
            step = rate * _tree(np.bincount(at[j], y - p, n), np.bincount(at[j], p * (1 - p), n), counts[j], least)
            table += step
            logit += step[at[j]]
    coarse = [(e := _edges(x[:, j], pair_bins), np.searchsorted(e, x[:, j], side="right")) for j in range(x.shape[1])]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        shape = len(coarse[i][0]) + 1, len(coarse[j][0]) + 1
        return np.bincount(coarse[i][1] * shape[1] + coarse[j][1], v, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-logit))
    gains = sorted(((_quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    chosen = [(i, j, np.zeros((len(coarse[i][0]) + 1, len(coarse[j][0]) + 1))) for gain, i, j in gains[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            p = 1 / (1 + np.exp(-logit))
            step = rate * _quadrants(grid(i, j, y - p), grid(i, j, p * (1 - p)))[1]
            table += step
            logit += step[coarse[i][1], coarse[j][1]]
    model.pairs = [(i, j, coarse[i][0], coarse[j][0], t) for i, j, t in chosen]
    return model


def held_out(modulus: int, remainder: int):
    """The rows that no label is learned from: crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def feature_table(docs: DataFrame, label: str) -> DataFrame:
    """``(doc_id, x array<double>, y)`` of every row of ``docs`` (doc_id, text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off):
                x = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64())), batch.column(2).slice(i, j - i)], names=["doc_id", "x", "y"])

    return docs.select("doc_id", "text", F.col(label).cast("int")).mapInArrow(run, "doc_id long, x array<double>, y int")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", max_rows: int = 50_000, held=None) -> Additive:
    """A model from the labelled rows of ``docs`` (doc_id, text).

    At most about ``max_rows`` rows are learned from, drawn by a hash of the id; fewer are all used. Rows
    for which ``held`` is true, and null ids and labels, are left out; of several labels the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    if held is not None:
        known = known.where(~held)
    share = max(1, -(-known.count() // max_rows))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    learned = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")  # known has at most about max_rows rows
    rows = feature_table(learned, "y").toArrow()
    order = np.lexsort((*np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES)).T, rows["doc_id"].to_numpy()))
    x = np.array(rows["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))[order]
    return fit(x, rows["y"].to_numpy().astype(np.float64)[order])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; labels of held-out rows aren't learned.

    Null and empty texts have all features 0 and a score like others; repeated rows and null ids stay;
    other columns are ignored.
    """
    held = held_out(modulus, remainder)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held=held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off):
                score = model.value.score(features(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held=held_out(modulus, remainder)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = K.utf8(batch.column(at))
            keep = [model.value.score(features(buf[off[i] : off[j]], off[i : j + 1] - off[i])) >= threshold for i, j in K.slices(off)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
