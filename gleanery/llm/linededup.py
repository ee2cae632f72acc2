"""Line dedup: exact copies of a line, and lines one word edit away, keep their earliest occurrence.

The distance is counted in words: one word put in, left out or replaced. A line's deletion neighbourhood
(itself with any one word left out) is emitted as hashed keys. Two lines of equal length are within one
edit exactly if they agree on a variant at the same place; lines of lengths n and n + 1 if a variant of the
longer one is the shorter one. So the earliest line of each key is all that a member has to meet, and one
minimum for each key replaces the pairs of a group. The partner found is then verified on the words.

Only lines that share a half with another one emit variants: of two lines within one edit, the first or the
last half is the same (halves of the shorter one's length), so nothing is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .stages import sieved, written

U64 = np.uint64
_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)
#: Words of the second hash lane.
_LANE = U64(0xD6E8FEB86659FD93)


class _Lines:
    """Lines with words of a slice of documents, and hashes of any run of a line's words in two lanes."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        w = K.words(buf, off, lower=False)
        n = len(w.hashes)
        self.words = w
        doc = K.owner(w.first)
        feeds = np.flatnonzero(buf == 0x0A)
        line = np.searchsorted(feeds, w.starts) - np.searchsorted(feeds, off[:-1])[doc]
        new = np.ones(n, dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
        self.a = np.flatnonzero(new)
        self.b = np.append(self.a[1:], n) if n else self.a
        self.doc, self.line = doc[self.a], line[self.a]
        self.pow, self.inv = K._powers(_B, n + 1), K._powers(_BI, n + 1)
        self.sums = []
        for h in (w.hashes, K.mix64(w.hashes ^ _LANE)):
            s = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(h * self.pow[:n], out=s[1:])
            self.sums.append(s)

    def run(self, lane: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        s = self.sums[lane]
        return (s[b] - s[a]) * self.inv[a]

    def whole(self, lane: int) -> np.ndarray:
        return K.mix64(self.run(lane, self.a, self.b) + (self.b - self.a).astype(np.uint64))

    def halves(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first and the last half for partners of which the shorter has m words."""
        tag = m.astype(np.uint64) * U64(2)
        return K.mix64(self.run(0, self.a, self.a + m // 2) ^ K.mix64(tag)), K.mix64(self.run(0, self.b - (m - m // 2), self.b) ^ K.mix64(tag + U64(1)))

    def variants(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in both lanes of line ``at`` without its word 0, 1, ..."""
        a, b = int(self.a[at]), int(self.b[at])
        i = np.arange(a, b)
        out = []
        for s in self.sums:
            v = (s[i] - s[a] + (s[b] - s[i + 1]) * U64(_BI)) * self.inv[a]
            out.append(K.mix64(v + U64(b - a - 1)))
        return out[0], out[1]


#: Words of a line from which exact copies go in the registered query and the pipeline, and from which lines one
#: edit away go: in shorter ones an edit is a third of the line or more.
LEAST, NEAR = 1, 4

#: Words as the kernels cut them: no other blanks than these.
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: A line with more than one in so many of all occurrences is hot; so there are fewer hot lines than this.
HOT = 10_000

#: log2 of the marks that keep most halves and variants which no other line has out of a shuffle.
HALF_BITS = 22

ROWS = "doc_id long, line_no int, h1 long, h2 long, n int, k0 long, k1 long, k2 long, k3 long"


def _line_rows(docs: DataFrame, least: int, near: int) -> DataFrame:
    """A row for each line of ``least`` or more words; half keys for lines of ``near`` or more, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            buf, off = K.utf8(batch.column(1))
            for i, j in K.slices(off):
                x = _Lines(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n = x.b - x.a
                keep = n >= least
                far = n < near
                p0, s0 = x.halves(n)
                p1, s1 = x.halves(np.maximum(n - 1, 1))
                cols = [ids.slice(i, j - i).take(pa.array(x.doc[keep])), pa.array(x.line[keep].astype(np.int32))]
                cols += [pa.array(K.signed(x.whole(k))[keep]) for k in (0, 1)]
                cols += [pa.array(n[keep].astype(np.int32)), *(pa.array(K.signed(k)[keep], mask=far[keep]) for k in (p0, s0, p1, s1))]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.mapInArrow(run, ROWS)


NEIGHBOURS = "v1 long, v2 long, at int, nr long, line string"


def _neighbourhoods(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys of the wanted lines: a row for each variant (``at``: the word left out), and one for the line itself (``at`` -1, with its text)."""
    of = wanted.groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("line_no", "h1", "h2", "nr"))).alias("lines"))
    with_text = sieved(docs, of.select(F.col("_id").alias("doc_id")), "doc_id").join(of, F.col("doc_id") == F.col("_id")).select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in NEIGHBOURS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            buf, off = K.utf8(batch.column(0))
            for i, j in K.slices(off, K.CHUNK):
                base = off[i]
                x = _Lines(buf[base : off[j]], off[i : j + 1] - base)
                place = {(d, k): r for r, (d, k) in enumerate(zip(x.doc.tolist(), x.line.tolist(), strict=True))}
                whole = [K.signed(x.whole(k)) for k in (0, 1)]
                cols: list[list] = [[] for _ in names]
                for d, lines in enumerate(batch.column(1).slice(i, j - i).to_pylist()):
                    for row in lines:
                        r = place.get((d, row["line_no"]), -1)
                        if r < 0 or (whole[0][r], whole[1][r]) != (row["h1"], row["h2"]):
                            continue  # another text under the same id
                        a, b = x.words.starts[x.a[r]], x.words.ends[x.b[r] - 1]
                        v1, v2 = x.variants(r)
                        m = len(v1) + 1
                        cols[0].append(np.append(K.signed(v1), row["h1"]))
                        cols[1].append(np.append(K.signed(v2), row["h2"]))
                        cols[2].append(np.append(np.arange(m - 1, dtype=np.int32), np.int32(-1)))
                        cols[3].append(np.full(m, row["nr"]))
                        cols[4] += [None] * (m - 1) + [bytes(buf[base + a : base + b]).decode()]
                if cols[4]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c), t) for c, t in zip(cols, types, strict=False)), pa.array(cols[4], pa.string())], names=names)

    return with_text.mapInArrow(run, NEIGHBOURS)


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether the word sequences differ by at most one word put in, left out or replaced."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one(_WORDS.findall(a), _WORDS.findall(b)) for a, b in zip(batch["line"].to_pylist(), batch["other"].to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["h1", "h2"])

    return pairs.select("h1", "h2", "line", "other").mapInArrow(run, "h1 long, h2 long")


def _near(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(h1, h2)`` of the lines that stand within one edit of an earlier line."""
    halves = distinct.where("k0 is not null").select("h1", "h2", "place", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = halves.groupBy("k").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("k")
    shared = written(shared, "halves")
    wanted = sieved(halves, shared, "k", HALF_BITS).join(shared, "k", "left_semi").select("h1", "h2", "place.doc_id", "place.line_no").distinct()
    # numbers in the order of places: one long to compare from here on
    wanted = written(wanted.orderBy("doc_id", "line_no").withColumn("nr", F.monotonically_increasing_id()), "wanted")
    keys = written(_neighbourhoods(docs, wanted), "variants")
    # a key that stands alone meets nothing: most are left out before they are shuffled whole
    met = keys.groupBy("v1").agg(F.count("*").alias("m")).where("m > 1").select("v1")
    variants = written(sieved(keys.where("at >= 0").select("v1", "v2", "at", "nr"), met, "v1", HALF_BITS), "met")
    lines = keys.where("at < 0").select(F.col("v1").alias("h1"), F.col("v2").alias("h2"), "nr", "line")
    # lines of equal length: the same variant, the same word left out
    same = variants.groupBy("v1", "v2", "at").agg(F.min("nr").alias("p"), F.max("nr").alias("z")).where("p < z").drop("z")
    equal = variants.join(same, ["v1", "v2", "at"]).select("nr", "p")
    # a variant that is a line itself: the two meet, and the shorter one meets its earliest longer partner
    longer = variants.join(lines.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.col("nr").alias("q")), ["v1", "v2"]).select("nr", "q")
    shorter = longer.groupBy(F.col("q").alias("nr")).agg(F.min("nr").alias("p"))
    best = equal.union(longer).union(shorter).where("p < nr").groupBy("nr").agg(F.min("p").alias("p"))
    pairs = best.join(lines, "nr").join(lines.select(F.col("nr").alias("p"), F.col("line").alias("other")), "p")
    return _verified(pairs).distinct()


def drop_plan(docs: DataFrame, least: int = 3, near: int = 8) -> DataFrame:
    """``(doc_id, dropped array<int>)``: numbers of the lines to drop, for documents that lose some."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = written(_line_rows(docs, least, near), "lines")
    place = F.struct("doc_id", "line_no")
    distinct = rows.groupBy("h1", "h2", "n").agg(F.min(place).alias("place"), F.count("*").alias("m"), *(F.max(k).alias(k) for k in ("k0", "k1", "k2", "k3")))
    distinct = written(distinct, "distinct")
    near_lines = _near(docs, distinct).select("h1", "h2", F.lit(True).alias("near"))
    fates = distinct.select("h1", "h2", F.col("place").alias("first"), "m").join(near_lines, ["h1", "h2"], "left").where("m > 1 or near")
    fates = written(fates, "fates")
    # the hot lines, at most HOT of them, go to their occurrences; the others meet theirs by the line's hash
    limit = (distinct.agg(F.sum("m")).first()[0] or 0) // HOT + 1
    cells = rows.select("h1", "h2", "doc_id", "line_no")
    hot = F.broadcast(fates.where(F.col("m") > limit))
    met = cells.join(hot, ["h1", "h2"]).unionByName(cells.join(hot, ["h1", "h2"], "left_anti").join(fates.where(F.col("m") <= limit), ["h1", "h2"]))
    lost = met.where(F.col("near").isNotNull() | (place != F.col("first")))
    return lost.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame, least: int = 3, near: int = 8) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` (int).

    A line is dropped if an equal line (word for word), or one within one word edit, stands earlier:
    smaller doc_id, then smaller line number. Lines of fewer than ``least`` words are kept, lines of fewer
    than ``near`` only lose to equal ones. Null texts stay null with 0 lines; rows with a null doc_id have
    no place in the order and stay whole; rows that share a doc_id share its line numbers, and so lose the
    same ones. Other columns stay, but for ``n_lines`` and ``n_dropped``, which are replaced.
    """
    mine = next(n for n in (f"line_dedup_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    plan = drop_plan(docs, least, near).select(F.struct("doc_id", "dropped").alias(mine))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*names).withColumn("text", F.col("text").cast("string"))
    joined = docs.join(plan, F.col("doc_id").cast("long") == F.col(f"{mine}.doc_id"), "left").select(*names, F.col(f"{mine}.dropped").alias(mine))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_lines int", "n_dropped int"])
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for x, gone in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                text = x.as_py()
                lines = [] if text is None else text.split("\n")
                if gone:
                    drop = set(gone)
                    kept = [line for k, line in enumerate(lines) if k not in drop]
                    text = "\n".join(kept)
                    n_dropped.append(len(lines) - len(kept))
                else:
                    n_dropped.append(0)
                texts.append(text)
                n_lines.append(len(lines))
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())], names=[*batch.schema.names[:-1], "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)
