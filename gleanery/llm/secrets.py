"""Secret scans: fixed patterns, and the guess cost of values in credential context.

A value after a credential word is priced by dynamic programming: the cheapest way to put it together from
dictionary words, dates, repeats, keyboard walks, sequences and brute force, in log2 of guesses, over all
segmentations. Costly values are secrets; "password: sunshine1" isn't one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")

# The base patterns of the task; letters of the keyword match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Wider context for priced values: more words, more separators, any printing characters.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|auth|credentials?|(?:api|access|private|client)[_-]?(?:key|secret|token)?)["']?[\x20\t]*[:=][\x20\t]*["']?([^\s"'<>]{6,})""", re.I | re.A)
#: A value of at least so many log2 guesses is a secret: about 10^10 guesses.
GUESS_BITS = 34.0

# Rows of a keyboard, of which walks are runs in either direction.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
#: Letters of the longest date, and of the longest unit of a repeat.
DATE_MOST, UNIT_MOST = 10, 8
_LEET = str.maketrans("013457$@!", "oleastsai")
#: No dictionary word is longer.
LONGEST = 16


def ranks(path: str) -> dict[str, int]:
    """Word ranks: letters-only entries of three or more of a public rank file, by rank (on every machine)."""
    import base64

    out: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower()
            if 3 <= len(word) <= LONGEST and word.isascii() and word.isalpha():
                out.setdefault(word, len(out) + 1)
    return out


def alphabet_bits(value: str) -> float:
    """log2 of the characters that brute force tries at each place of ``value``."""
    return math.log2(max(10, 10 * any(map(str.isdigit, value)) + 26 * any(map(str.islower, value)) + 26 * any(map(str.isupper, value)) + 33 * (not value.isalnum())))


def word_bits(part: str, words: dict[str, int]) -> float:
    """A dictionary word's rank, a bit for capitals, two for letters written as signs."""
    low = part.lower()
    costs = [math.log2(rank) + extra + (part != low) for text, extra in ((low, 0.0), (low.translate(_LEET), 2.0)) if (rank := words.get(text))]
    return min(costs, default=math.inf)


def guess_bits(value: str, words: dict[str, int], most: float = math.inf, char: float | None = None, known: dict[str, float] | None = None) -> float:
    """log2 guesses of the cheapest segmentation of ``value``; infinite if that is ``most`` or over.

    A segment is a brute-force character, or one of these with a bit for its kind and place: a dictionary word, a
    date or year, a keyboard walk of three letters or more, or a unit of up to ``UNIT_MOST`` letters written
    several times, which costs what the unit itself does and the log2 of the times. Every part that is one of
    them is tried, from every start to every end, in values of any length. ``char`` and ``known`` are the cost of a character and of units seen, for the recursion.
    """
    n = len(value)
    char = alphabet_bits(value) if char is None else char
    known = {} if known is None else known
    low = value.lower()
    best = [0.0] + [math.inf] * n
    runs = [(0, -1)] * (UNIT_MOST + 1)  # by length of the unit: the run last looked at, from where it is known to where it ends
    starts: dict[tuple[int, int], tuple[int, int, float]] = {}  # by length and place in the unit: the run's end, the last start tried and its cost
    for i in range(n):
        here = best[i]
        if here >= most:
            continue
        best[i + 1] = min(best[i + 1], here + char)
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            best[j] = min(best[j], here + word_bits(value[i:j], words) + 1)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + DATE_MOST) + 1):
                if _DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], here + math.log2(365 * 120 if j - i > 4 else 120) + 1)
        j = i + 1
        while j < n and (low[j - 1], low[j]) in _NEXT:
            j += 1
            if j - i >= 3:
                best[j] = min(best[j], here + math.log2(47 * (j - i)) + 2)
        for u in range(1, min(UNIT_MOST, (n - i) // 2) + 1):
            begin, end = runs[u]
            if not begin <= i <= end - u:
                begin, end = i, i + u
                while end < n and value[end] == value[end - u]:
                    end += 1
                runs[u] = begin, end
            times = (end - i) // u
            if times < 2:
                continue
            run, at, cost = starts.get((u, i % u), (-1, 0, 0.0))
            if run == end and here - cost >= math.log2((i - at) / (2 * u) + 1):
                continue
            starts[u, i % u] = end, i, here
            unit = value[i : i + u]
            if unit not in known:
                known[unit] = guess_bits(unit, words, math.inf, char, known)
            inner = next((d for d in (1, 2, 3, 4) if d < u and u % d == 0 and unit == unit[:d] * (u // d)), None)
            if inner:
                if unit[:inner] not in known:
                    known[unit[:inner]] = guess_bits(unit[:inner], words, math.inf, char, known)
                if known[unit] >= known[unit[:inner]] + math.log2(u // inner):
                    continue
            for k in range(2, times + 1):
                if (cost := here + known[unit] + math.log2(k) + 1) >= most:
                    break
                best[i + k * u] = min(best[i + k * u], cost)
    return best[n] if best[n] < most else math.inf


def find(text: str, words: dict[str, int]) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of every span, by start and kind; kinds are places in ``KINDS``, positions code points."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        out += [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_bits(m[1].rstrip(".,;)"), words, GUESS_BITS) == math.inf]
    return sorted(out)


_WORDS: dict[str, dict[str, int]] = {}


def scan(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found array<struct<kind,start,end>>)`` of every text; null and empty texts have none.

    Row by row: repeated rows and null ids stay; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORDS.get(rank_file) or _WORDS.setdefault(rank_file, ranks(rank_file))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(x.as_py() or "", words)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with each span's characters replaced by one mark; overlapping spans count as one."""
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            out += [text[at : max(s, at)], "[secret]"] if s >= at else []
            at = e
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, from ``scan``."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"] != "guess")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", line), ",").alias("spans"),
    )
