"""N-gram Jaccard join with set-relation skipping (after Wang et al., "Leveraging Set Relations in Exact Set Similarity Join", 2017).

A document is its set of distinct word shingles; two link when the Jaccard similarity of their sets
reaches a threshold. The components of all links come out, exactly, without listing the links:

1. Equal sets become one (a grouping by a 128-bit set hash). Each keeps a parity bitmap, two to four bits for
   each shingle: sets whose bitmaps differ in more bits than linked sets can differ in shingles aren't compared.
2. Index. Every set posts the shingles of its prefix, rare ones first, with its size and the room from there
   on. The head of a list is its set with most room; every set is compared with the head that it shares most
   lists with. Sets that link form clusters; each has a leader.
3. Rounds in cells. Sets that share list heads, in the order of how their bitmaps differ from one of those heads',
   fall into cells of ``CELL``. Each set of a cell is compared with the ``NEAREST`` sets of other
   clusters by bitmaps; the pairs that link join clusters, until a round joins few. Copies of one text that link only
   here and there become a few clusters before their pairs are looked at.
4. Index with skipping. Lists that two clusters share are read again by size, in blocks with the best room of
   each: blocks whose sizes or places rule a link out are skipped, and so are pairs within a cluster. What is
   left are pairs of sets of different clusters.
5. Answers by relation. Of the pairs between two clusters, only the leaders' is compared at first. If they
   link, the others are settled; else the answer for a pair of members follows from the leaders'
   intersection and how far each is from its leader, and is computed in full only where that bound leaves it open.

Rarity comes from a sketch of shingle counts over all documents. It only orders the shingles and tells which
lists are dealt to several tasks, so its collisions cost time and no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .stages import Scratch, sieved

U64 = np.uint64
#: Words in a shingle.
SIZE = 5
#: log2 of the counters in the sketch: 8 MB a task, whatever the input. They travel in parts of 32 KB.
SKETCH_BITS = 20
SKETCH_PARTS = 256
#: Groups of tasks whose counters are added up first.
LANES = 16
#: Most bits of a set's bitmap.
BITMAP = 1 << 16
#: Members of a leader that are compared in one task.
MEMBERS = 1000
#: Postings of a list that one task takes, if the sketch is fine enough to tell; else four times its mean count.
LIST = 50_000
#: Postings in a block of a list.
BLOCK = 64
#: Sets whose bitmaps are compared with one another at once, those of them that a set is compared with, rounds at most, and places in a set's key of the order.
CELL, NEAREST, ROUNDS, PLACES = 1000, 4, 3, 12
#: Pairs, and rows of short lists, that a task takes together.
PAIRS, TOGETHER = 200_000, 100_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of all its words together if they are fewer than ``size``."""
    w = K.words(buf, off)
    grams = K.windows(w.hashes, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(K.windows(w.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sums(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit hash of a set, as two signed numbers."""
    both = np.array([s.sum(dtype=np.uint64), K.mix64(s).sum(dtype=np.uint64)], dtype=np.uint64)
    return tuple(K.signed(both).tolist())


def parity(s: np.ndarray) -> bytes:
    """A set's parity bitmap: each shingle turns one bit over. Its bits are a power of two, twice the set's size or more, up to ``BITMAP``."""
    bits = min(BITMAP, 1 << max(6, (max(2 * len(s), 1) - 1).bit_length()))
    return np.packbits(np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Least number of shingles that two sets with these bitmaps don't share. A longer bitmap folds to a shorter one."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    m = min(len(x), len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, m)) ^ np.bitwise_xor.reduce(y.reshape(-1, m))).sum())


def _batches(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 * K.CHUNK):
    """Slices of each batch with their bytes and offsets."""
    for batch in batches:
        buf, off = K.utf8(batch.column(text))
        for i, j in K.slices(off, most):
            yield batch.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


PROFILE = "doc_id long, n long, s1 long, s2 long, bits binary, part int, counts binary"


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document, and at the end of each task the counts of its shingles in ``SKETCH_PARTS`` rows (``part`` isn't null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for part, buf, off in _batches(batches, 1):
            sets = shingle_sets(buf, off, size)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((flat >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            sums = [_sums(s) for s in sets]
            cols = [[len(s) for s in sets], [x for x, _ in sums], [x for _, x in sums], [parity(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, cols, kinds[1:5]), pa.nulls(len(sets), kinds[5]), pa.nulls(len(sets), kinds[6])], names=_names(PROFILE))
        each = counts.reshape(SKETCH_PARTS, -1)
        for k in range(SKETCH_PARTS):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds[:5]), pa.array([k], kinds[5]), pa.array([each[k].tobytes()], kinds[6])], names=_names(PROFILE))

    return docs.mapInArrow(run, PROFILE)


def _summed(counts: DataFrame, *keys: str) -> DataFrame:
    """``(part, counts)``: counters added up by part in each partition of the keys, as 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), dtype=np.int64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "counts"])

    return counts.repartition(*keys).select("part", "counts").mapInArrow(run, "part int, counts binary")


def _levels(profiles: DataFrame) -> np.ndarray:
    """log2 of the count of each of the sketch's counters, rounded up: 8 MB of counters, for any input.

    They are added up in two steps, so that no task has those of all tasks of a large input.
    """
    lanes = profiles.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(LANES)).alias("lane"))
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), dtype=np.uint8)
    for row in _summed(_summed(lanes, "part", "lane"), "part").collect():
        out[row["part"]] = np.ceil(np.log2(np.frombuffer(row["counts"], dtype=np.int64) + 1)).astype(np.uint8)
    return out.ravel()


PREFIX = "doc_id long, n long, s1 long, s2 long, tokens array<long>"
POSTING = "token long, salt int, sid long, n int, room int"


def _prefixes(docs: DataFrame, levels: np.ndarray, size: int, percent: int) -> DataFrame:
    """The shingles of each set's prefix, rare ones first."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for part, buf, off in _batches(batches, 1):
            tokens, sizes, sums = [], [], []
            for s in shingle_sets(buf, off, size):
                n = len(s)
                sizes.append(n)
                sums.append(_sums(s))
                k = n - (n * percent + 99) // 100 + 1 if n else 0  # two sets of the least similarity share one of so many
                rank = (levels[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << U64(58)) | (s >> U64(6))
                first = np.argpartition(rank, k - 1)[:k] if k < n else np.arange(n)
                tokens.append(K.signed(s[first[np.argsort(rank[first])]]))
            offsets = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([x for x, _ in sums], pa.int64()), pa.array([x for _, x in sums], pa.int64()), lists], names=_names(PREFIX))

    return docs.mapInArrow(run, PREFIX)


def _postings(prefixes: DataFrame, sets: DataFrame, levels: np.ndarray, most: int) -> DataFrame:
    """A row for each prefix shingle of each distinct set; ``room``: how much of the set is left from the shingle on.

    Lists that may have more than ``most`` postings are dealt to several tasks: they get a salt over 0.
    """
    shared = prefixes.sparkSession.sparkContext.broadcast(levels)
    rows = prefixes.join(sets.select(F.col("rep").alias("doc_id"), "n", "s1", "s2", "sid"), ["doc_id", "n", "s1", "s2"]).select("sid", "n", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            lists = batch.column(2)
            k = np.diff(lists.offsets.to_numpy())
            t = lists.flatten().to_numpy()
            sid, n = (np.repeat(batch.column(c).to_numpy(), k) for c in (0, 1))
            room = n - (np.arange(len(t)) - np.repeat(np.cumsum(k) - k, k))
            count = 1 << levels[(K.unsigned(t) >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int64)
            salts = -(-count // most)
            salt = np.where(salts > 1, 1 + (K.mix64(K.unsigned(sid)) % salts.astype(np.uint64)).astype(np.int64), 0)
            cols = (t, salt.astype(np.int32), sid, n.astype(np.int32), room.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=_names(POSTING))

    return rows.mapInArrow(run, POSTING)


LISTED = POSTING + ", head long"


def _listed(postings: DataFrame) -> DataFrame:
    """Postings that stand in a list with others, with the list's head: the set with most room. A task holds a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the head of the list that goes on
        given = False
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            token, salt, sid = cols[:3]
            new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(token)))
            group = np.cumsum(new) - 1
            keep = (size[group] > 1) | (salt > 0)
            keep[0] &= not (held and given)
            last = int(start[-1])
            given = bool(size[-1] > 1 or salt[-1] > 0)
            held = [c[last : last + 1] for c in cols]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in cols), pa.array(sid[start[group]][keep])], names=_names(LISTED))

    return postings.repartition("token", "salt").sortWithinPartitions("token", "salt", F.desc("room"), "sid").mapInArrow(run, LISTED)


def _need(percent: int):
    """Least intersection of two sets of these sizes that link."""
    return lambda x, y: -(-(x + y) * percent // (100 + percent))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of sets whose sizes and bitmaps allow a link."""
    need = _need(percent)
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"))
    rows = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            ok = [differing(x[i], y[i]) <= na[i] + nb[i] - 2 * need(na[i], nb[i]) for i in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def _intersections(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, tables: Scratch, name: str) -> DataFrame:
    """``(a, b, na, nb, both)``: set sizes and the size of the intersection for each of the distinct written ``pairs`` (a, b).

    Each a's text goes, once for every ``MEMBERS`` of its partners, before its partners' texts in a sorted
    partition; a task holds one set and a batch at a time.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("sid"))
    heads = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("sid"))
    wanted = members.unionByName(heads).join(sets.select("sid", "rep", "s1", "s2"), "sid")
    texts = sieved(docs.select("doc_id", "text"), wanted.select(F.col("rep").alias("doc_id")), "doc_id")
    rows = texts.join(wanted, texts["doc_id"] == wanted["rep"]).select("a", "salt", "role", "sid", "s1", "s2", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, of = None, None
        for part, buf, off in _batches(batches, 6):
            out: list[list[int]] = [[], [], [], [], []]
            for a, role, i, s1, s2, s in zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4, 5)), shingle_sets(buf, off, size), strict=True):
                if _sums(s) != (s1, s2):
                    continue  # another text under the same id
                if role == 0:
                    head, of = s, a
                elif of == a:
                    small, large = (s, head) if len(s) <= len(head) else (head, s)
                    at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                    both = int(np.count_nonzero(large[at] == small)) if len(small) else 0
                    for c, v in zip(out, (a, i, len(head), len(s), both), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "na", "nb", "both"])

    return tables.write(rows.mapInArrow(run, "a long, b long, na long, nb long, both long"), name)


def cell_pairs(cluster: np.ndarray, n: np.ndarray, bits: list[bytes], percent: int) -> set[tuple[int, int]]:
    """Places (low, high) of each set and the ``NEAREST`` nearest by their bitmaps of those of other clusters, as far as sizes and bitmaps allow a link."""
    need = _need(percent)
    least = min(map(len, bits))
    maps = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, least)) for x in bits]).view(np.uint64)
    out = set()
    for i in range(len(n)):
        j = np.flatnonzero((cluster != cluster[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent))
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(1).astype(np.int64)
        ok = np.flatnonzero(apart <= n[i] + n[j] - 2 * need(n[i], n[j]))
        for k in j[ok[np.argsort(apart[ok], kind="stable")[:NEAREST]]].tolist():
            out.add((min(i, k), max(i, k)))
    return out


def _order_key(bits: bytes, lead: bytes, turn: int) -> bytes:
    """The first places, in an order that ``turn`` shuffles, at which two bitmaps differ: like differences begin alike."""
    x, y = (np.frombuffer(v, np.uint8) for v in (bits, lead))
    m = min(len(x), len(y))
    places = np.flatnonzero(np.unpackbits(np.bitwise_xor.reduce(x.reshape(-1, m)) ^ np.bitwise_xor.reduce(y.reshape(-1, m))))
    shuffled = K.mix64(places.astype(np.uint64) + U64((turn + 1) << 32)) >> U64(48)
    return np.sort(shuffled)[:PLACES].astype(">u2").tobytes()


def _near(heads: DataFrame, sets: DataFrame, clusters: DataFrame, turn: int, percent: int) -> DataFrame:
    """``(a, b)``: pairs of sets of different clusters with near bitmaps, at most ``NEAREST`` for each set.

    Sets are grouped by the least of their lists' heads in the order of ``turn``. Groups with several clusters are
    sorted along ranges, so that a group of any size is dealt to several tasks.
    """
    rows = heads.select("sid", F.col(f"g{turn}").alias("g")).join(clusters.toDF("sid", "cluster"), "sid", "left").withColumn("cluster", F.coalesce("cluster", "sid"))
    mixed = rows.groupBy("g").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("g")
    rows = rows.join(mixed, "g").join(sets.select("sid", "n", "bits"), "sid").join(sets.select(F.col("sid").alias("g"), F.col("bits").alias("lead")), "g")
    octave = F.floor(F.log2("n") + 0.5 * (turn % 2)).cast("int")  # sizes of about a factor 2, on other bounds in the next round

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [_order_key(x, y, turn) for x, y in zip(batch["bits"].to_pylist(), batch["lead"].to_pylist(), strict=True)]
            yield batch.select(["g", "octave", "sid", "cluster", "n", "bits"]).append_column("key", pa.array(key, pa.binary()))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, octave, sid, cluster, n, bits = (batch.column(c).to_pylist() for c in range(6))
            a, b, begin = [], [], 0
            for k in range(1, len(g) + 1):
                if k == len(g) or k - begin == CELL or (g[k], octave[k]) != (g[begin], octave[begin]):
                    if len(set(cluster[begin:k])) > 1:
                        for i, j in sorted(cell_pairs(np.array(cluster[begin:k]), np.array(n[begin:k]), bits[begin:k], percent)):
                            a.append(sid[begin + i])
                            b.append(sid[begin + j])
                    begin = k
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rows.select("g", octave.alias("octave"), "sid", "cluster", "n", "bits", "lead").mapInArrow(keys, "g long, octave int, sid long, cluster long, n long, bits binary, key binary")
    order = ["g", "octave", "key", "sid"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cells, "a long, b long")


def list_pairs(sid: np.ndarray, cluster: np.ndarray, n: np.ndarray, room: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a list's sets that may link, of different clusters; the arrays are sorted by size.

    Sets of the list's largest cluster only meet the others. Each of the others looks at the blocks within its
    size bounds, and skips those of which the best room is too little.
    """
    need = _need(percent)
    names, of = np.unique(cluster, return_inverse=True)
    main = of == np.argmax(np.bincount(of, minlength=len(names)))
    starts = np.arange(0, len(n), BLOCK)
    best, smallest = np.maximum.reduceat(room, starts), n[starts]
    for i in np.flatnonzero(~main).tolist():
        begin, end = np.searchsorted(n, -(-n[i] * percent // 100)), np.searchsorted(n, n[i] * 100 // percent, side="right")
        first, last = begin // BLOCK, -(-end // BLOCK)
        least = need(smallest[first:last], n[i])
        for k in (np.flatnonzero((best[first:last] >= least) & (room[i] >= least)) + first).tolist():
            j = np.arange(max(begin, k * BLOCK), min(end, (k + 1) * BLOCK))
            j = j[(main[j] | (j > i)) & (of[j] != of[i]) & (np.minimum(room[i], room[j]) >= need(n[i], n[j]))]
            if len(j):
                yield np.full(len(j), i, dtype=np.int64), j


def short_pairs(group: np.ndarray, cluster: np.ndarray, n: np.ndarray, room: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many lists of at most ``BLOCK`` postings at once; the arrays are sorted by list, then size."""
    need = _need(percent)
    at = np.arange(len(group))
    for step in range(1, BLOCK):
        at = at[at + step < len(group)]
        at = at[(group[at] == group[at + step])]
        at = at[n[at] * 100 >= n[at + step] * percent]  # beyond the size bound the rest of the list is skipped
        if not len(at):
            return
        ok = (cluster[at] != cluster[at + step]) & (np.minimum(room[at], room[at + step]) >= need(n[at], n[at + step]))
        if ok.any():
            yield at[ok], at[ok] + step


CANDIDATES = "a long, b long, ca long, cb long"


def _candidates(rows: DataFrame, most: int, percent: int) -> DataFrame:
    """``(a, b, ca, cb)``, ca < cb: sets of different clusters that share a prefix shingle and may link by sizes and places.

    ``rows``: postings with their clusters. A list of more than ``most`` postings is dealt to several tasks: the sets
    of its largest cluster, which don't meet one another, by a hash; the others go to all of them.
    """
    hot = rows.where("salt > 0").groupBy("token", "cluster").agg(F.count("*").alias("m")).groupBy("token").agg(F.max_by("cluster", "m").alias("main"), F.sum("m").alias("many"))
    hot = hot.select("token", "main", F.ceil(F.col("many") / most).cast("int").alias("salts")).where("salts > 1")
    rows = rows.select("token", "sid", "cluster", "n", "room").join(hot, "token", "left")
    places = F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(F.col("cluster") == F.col("main"), F.array(F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    rows = rows.select("token", F.explode(places).alias("salt"), "sid", "cluster", "n", "room")

    def lists(parts: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        token, salt, *cols = (np.concatenate(c) for c in zip(*parts, strict=True))
        new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(new)))
        mixed = np.minimum.reduceat(cols[1], start) != np.maximum.reduceat(cols[1], start)
        order = np.lexsort((cols[0], cols[2], group))
        order = order[mixed[group[order]]]
        group = group[order]
        sid, cluster, n, room = (c[order].astype(np.int64) for c in cols)

        def rows(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            i, j = np.where(cluster[i] > cluster[j], j, i), np.where(cluster[i] > cluster[j], i, j)
            return np.stack([sid[i], sid[j], cluster[i], cluster[j]], axis=1)

        short = np.flatnonzero(size[group] <= BLOCK)
        for i, j in short_pairs(group[short], cluster[short], n[short], room[short], percent):
            yield rows(short[i], short[j])
        for g in np.flatnonzero(mixed & (size > BLOCK)).tolist():
            at = np.flatnonzero(group == g)
            for i, j in list_pairs(sid[at], cluster[at], n[at], room[at], percent):
                yield rows(at[i], at[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        found: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(4)], names=_names(CANDIDATES))

        def add(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for x in lists(parts):
                found.append(x)
                if sum(map(len, found)) > PAIRS:
                    yield out()

        rows = 0
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if not len(cols[0]):
                continue
            rows += len(cols[0])
            before = [held[-1][k][-1:] if held else cols[k][:1] for k in (0, 1)]
            change = np.flatnonzero(np.logical_or(*(c != np.append(b, c[:-1]) for c, b in zip(cols, before, strict=False))))
            if len(change) and rows > TOGETHER:
                last = int(change[-1])
                yield from add([*held, [c[:last] for c in cols]])
                held, rows = [], len(cols[0]) - last
                cols = [c[last:] for c in cols]
            held.append(cols)
        if held:
            yield from add(held)
        yield out()

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(run, CANDIDATES).distinct()


def _apart(pairs: DataFrame, found: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs whose ends aren't in one component yet."""
    ends = pairs.join(found.toDF(a, "_a"), a, "left").join(found.toDF(b, "_b"), b, "left")
    return ends.where(f"coalesce(_a, {a}) != coalesce(_b, {b})").drop("_a", "_b")


def similar_components(docs: DataFrame, percent: int = 80, size: int = SIZE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text).

    Words are maximal runs other than 0x20 and 0x09-0x0D with A-Z folded; a set is the distinct shingles of
    ``size`` words, or all words as one if they are fewer; empty and null texts have none and link with
    nothing. Two rows link when 100 * intersection >= percent * union; ``component_id`` is the smallest
    doc_id reachable. Rows that share a doc_id are one node with all their sets. A null doc_id gets a null
    component and takes no part. A row without words
    keeps its own id, also where that id has other texts. Other columns are left out; an empty table gives no rows.
    """
    tables = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.where("doc_id is not null and text is not null")
    profiles = tables.write(_profiles(docs, size), "profiles")
    levels = _levels(profiles)
    rows = profiles.where("part is null").select("doc_id", "n", "s1", "s2", "bits")
    grouped = rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    sets = tables.write(grouped.withColumn("sid", F.monotonically_increasing_id()), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    most = max(LIST, 4 * (total >> SKETCH_BITS))
    owned = rows.select("doc_id", "n", "s1", "s2").join(sets.select("n", "s1", "s2", "sid"), ["n", "s1", "s2"], "left")
    owned = tables.write(owned.select("doc_id", "n", "sid"), "owned")
    tables.drop(profiles)

    listed = tables.write(_listed(_postings(_prefixes(ids, levels, size, percent), sets, levels, most)), "listed")
    linked = f"both * 100 >= (na + nb - both) * {percent}"
    # each set and the head that it shares most lists with
    most_shared = F.max_by("head", F.when(F.col("head") != F.col("sid"), F.struct("m", -F.col("head")))).alias("a")
    turns = [F.min_by("head", F.xxhash64("head", F.lit(r))).alias(f"g{r}") for r in range(ROUNDS)]
    heads = tables.write(listed.groupBy("sid", "head").agg(F.count("*").alias("m")).groupBy("sid").agg(most_shared, *turns), "heads")
    stars = tables.write(_possible(heads.where("a is not null").select("a", F.col("sid").alias("b")), sets, percent), "stars")
    links = _intersections(ids, sets, stars, size, tables, "near_heads").where(linked).select("a", "b")
    # sets of one doc_id belong together
    shared = owned.where("doc_id is not null and sid is not null").groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a < z")
    several = owned.join(shared, "doc_id").where("sid > a").select("a", F.col("sid").alias("b")).distinct()
    links = tables.write(links.unionByName(several), "links")
    clusters = components(links)
    for turn in range(ROUNDS):
        near = tables.write(_near(heads, sets, clusters, turn, percent), "near")
        compared = near.count()
        more = _intersections(ids, sets, near, size, tables, "near_pairs").where(linked).select("a", "b") if compared else near
        joined = more.count()
        if joined:
            # the clusters' stars stand for the links that made them
            links = tables.write(clusters.toDF("a", "b").unionByName(more), "links")
            clusters = components(links)
        if joined * 10 < compared or not joined:  # what is left is mostly apart
            break

    # one row of clusters at most for each set, so that there stay as many rows as postings
    placed = listed.select("token", "salt", "sid", "n", "room").join(clusters.toDF("sid", "cluster"), "sid", "left").withColumn("cluster", F.coalesce("cluster", "sid"))
    placed = tables.write(placed, "placed")
    tables.drop(listed)
    candidates = tables.write(_candidates(placed, most, percent), "candidates")
    tables.drop(placed)
    pairs = tables.write(_possible(candidates, sets, percent), "possible")
    open_ = tables.write(candidates.join(pairs, ["a", "b"], "left_semi"), "open")
    leaders = tables.write(open_.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "leaders")
    between = _intersections(ids, sets, leaders, size, tables, "between")
    links = clusters.toDF("a", "b").unionByName(between.where(linked).select("a", "b"))
    found = components(tables.write(links, "links"))

    # the answer for members follows from their leaders' and their distances from them
    members = _apart(open_, found).where("a != ca or b != cb")
    members = tables.write(members.join(between.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "both"), ["ca", "cb"]), "members")
    if not members.isEmpty():
        ends = members.select("ca", "a").union(members.select("cb", "b")).toDF("a", "b").where("a != b").distinct()
        ends = tables.write(ends, "ends")
        away = _intersections(ids, sets, ends, size, tables, "away").select(F.col("b").alias("sid"), (F.col("nb") - F.col("both")).alias("away"))
        sizes = sets.select("sid", "n").join(away, "sid", "left").select("sid", "n", F.coalesce("away", F.lit(0)).alias("away"))
        far = members.join(sizes.toDF("a", "na", "da"), "a").join(sizes.toDF("b", "nb", "db"), "b")
        # |x & y| <= |leaders' intersection| + what x and y have beyond their leaders
        far = tables.write(far.where(f"(both + da + db) * {100 + percent} >= (na + nb) * {percent}").select("a", "b").distinct(), "far")
        more = _intersections(ids, sets, far, size, tables, "rest").where(linked).select("a", "b")
        found = components(tables.write(found.toDF("a", "b").unionByName(more), "links"))
    named = sets.select("sid", "rep").join(found.toDF("sid", "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.select("sid", "component").join(lowest, "component").select("sid", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return owned.join(labels, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
