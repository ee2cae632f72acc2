"""Best-fit packing with a swap-based local search.

Documents are tokenised and cut, then packed in blocks of pieces: best fit by decreasing length, then moves,
one-for-one and two-for-one exchanges out of the lightest underfull sequences. Every step increases the sum
of squared fills; a sequence that loses its last piece is gone.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import written

CAPACITY = 2048
#: Pieces packed together by one task: a few MB; each block leaves at most about one sequence that isn't full.
BLOCK = 50_000
#: Encoded chunks that a worker keeps; others are encoded anew each time.
CACHE = 300_000

_LOADED: dict[str, "Encoder"] = {}
#: A blank before another one: only then may a pre-token reach over the place before a blank.
_JOINED = re.compile(r" \s")


class Encoder:
    """Token ids, as little-endian 32-bit bytes, of the byte-level BPE in a ``tokenizers`` file.

    Texts are encoded by chunks that begin at a blank, where this tokenizer's pattern always begins a new
    pre-token, and the chunks' ids are kept. The merges run in tiktoken over the file's own vocabulary. Texts
    with special tokens or blanks in a row go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        # the printable stand-ins of byte-level BPE: printable Latin-1 bytes are themselves, the others follow from 256
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = tuple(special)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if _JOINED.search(text) or any(s in text for s in self.special):
            return array.array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        known = self.known
        chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
        out = list(map(known.get, chunks))
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    ids = known.get(chunks[k])
                    if ids is None:
                        ids = array.array("I", self.fast.encode_ordinary(chunks[k])).tobytes()
                        if len(known) < CACHE:
                            known[chunks[k]] = ids
                    out[k] = ids
        return b"".join(out)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids with ``end`` after them, cut if longer than ``capacity``, the first piece taking the remainder."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = Encoder(tokenizer)
        encoder = _LOADED[tokenizer]
        tail = array.array("I", [end]).tobytes()
        for batch in batches:
            rows, cols = [], [[], [], [], []]
            for d, x in enumerate(batch.column(1)):
                ids = encoder.encode(x.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n - (n - 1) // capacity * capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(d)
                    for c, v in zip(cols, (k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of pieces (by place): each piece, longest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # rooms for which there is a sequence
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            bins[b].append(i)
            room -= n
        else:
            b, room = len(bins), capacity - n
            bins.append([i])
        if room:
            free[room].append(b)
            mask |= 1 << room
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull sequences until none can be emptied; full ones stay."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    live = sum(1 for f in fill if f)
    owner = np.array([b for b, x in enumerate(bins) if fill[b] < capacity for _ in x], dtype=np.int64)
    items = np.array([i for b, x in enumerate(bins) if fill[b] < capacity for i in x], dtype=np.int64)
    if live <= least or not len(items):
        return [b for b in bins if b]
    at = {int(i): k for k, i in enumerate(items)}
    size = np.array([lengths[i] for i in items], dtype=np.int64)
    room = np.array([capacity - f for f in fill], dtype=np.int64)

    def move(i: int, to: int) -> None:
        k = at[i]
        a = int(owner[k])
        bins[a].remove(i)
        bins[to].append(i)
        owner[k] = to
        room[a] += lengths[i]
        room[to] -= lengths[i]

    def step(b: int) -> bool:
        """One move or exchange that leaves sequence ``b`` lighter and another, at least as full, fuller."""
        here = room[owner]
        other = (owner != b) & (here <= room[b]) & (here > 0)
        mine = sorted(bins[b], key=lambda i: -lengths[i])
        for i in mine:
            fits = np.flatnonzero(other & (here >= lengths[i]))
            if len(fits):
                move(i, int(owner[fits[np.argmin(here[fits])]]))
                return True
        # by total length: whether some piece elsewhere is shorter and leaves room for it
        takes = np.zeros(capacity + 2, dtype=np.int64)
        np.add.at(takes, size[other] + 1, 1)
        np.add.at(takes, size[other] + here[other] + 1, -1)
        takes = np.cumsum(takes) > 0
        x = np.array([lengths[i] for i in mine], dtype=np.int64)
        first, second = np.triu_indices(len(mine), 1)
        sums = np.concatenate([x, x[first] + x[second]])
        able = np.flatnonzero(takes[np.minimum(sums, capacity + 1)] & (sums <= capacity))
        if not len(able):
            return False
        g = int(able[0])
        group = [mine[g]] if g < len(mine) else [mine[first[g - len(mine)]], mine[second[g - len(mine)]]]
        fits = np.flatnonzero(other & (size < sums[g]) & (size + here >= sums[g]))
        k = int(fits[np.argmin(size[fits])])
        to, j = int(owner[k]), int(items[k])
        move(j, b)
        for i in group:
            move(i, to)
        return True

    again = True
    while again and live > least:  # passes over the sequences, lightest first, until one changes nothing
        again = False
        stuck: set[tuple[int, ...]] = set()  # contents that nothing can be taken from, until something changes
        for b in np.argsort(-room, kind="stable").tolist():
            if live <= least:
                break
            if not bins[b] or room[b] <= 0:
                continue
            content = tuple(sorted(lengths[i] for i in bins[b]))
            if content in stuck:
                continue
            changed = False
            while bins[b] and step(b):
                changed = True
            if changed:
                again = True
                stuck.clear()
            if bins[b]:
                stuck.add(tuple(sorted(lengths[i] for i in bins[b])))
            else:
                room[b] = 0
                live -= 1
    return [b for b in bins if b]


PACKED = PIECES + ", sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with ``sequence_id`` and ``offset`` in it.

    A null or empty text is the end token alone. Null and repeated ids are packed like any other row; other columns are
    left out; an empty table gives no rows. Sequences don't reach over blocks of about ``BLOCK`` pieces, which are dealt
    by a hash of the piece. In a block pieces are taken in the order of their columns, so that ties fall alike in
    every run; equal rows are interchangeable.
    """
    cut = written(pieces(docs, tokenizer, capacity, end), "pieces")
    blocks = max(1, -(-cut.count() // BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
        # the same order whenever the task runs, whatever order the rows come in
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
        lengths = table["length"].to_pylist()
        if not lengths:
            return
        block = TaskContext.get().partitionId() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = block + k, at
                at += lengths[i]
        yield from table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)

    return cut.repartition(blocks, F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(run, PACKED)
