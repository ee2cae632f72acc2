"""Fill-in-the-middle: a text is cut at two of its token boundaries, and the middle goes to the end.

The boundaries of a text are a set of code-point offsets, kept in the manner of Roaring bitmaps: a container for
each 2^16 offsets, as an array, a bitmap or runs, whichever is smallest, and the containers' cumulative
cardinalities. The k-th boundary comes from a search over these and a select inside one container.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels

# Marks of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut, and of a hundred cut ones so many have the suffix first.
CUT, SUFFIX_FIRST = 90, 20

#: Offsets of a container, and bytes of its bitmap.
SPAN, BITMAP = 1 << 16, 1 << 13

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POPULATION = np.array([b.bit_count() for b in range(256)], dtype=np.uint8)


class ArrayContainer:
    """Sorted members."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """A bit for each of the 2^16 places."""

    def __init__(self, low: np.ndarray):
        marks = np.zeros(SPAN, dtype=bool)
        marks[low] = True
        self.bits = np.packbits(marks, bitorder="little")

    def select(self, k: int) -> int:
        upto = np.cumsum(_POPULATION[self.bits], dtype=np.int64)
        byte = int(np.searchsorted(upto, k, side="right"))
        before = int(upto[byte - 1]) if byte else 0
        return 8 * byte + int(np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1], bitorder="little"))[k - before])


class RunContainer:
    """First members of runs, and the cardinality up to each run's end."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.starts = low[first].astype(np.uint16)
        self.upto = np.append(first[1:], len(low))

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.upto, k, side="right"))
        return int(self.starts[run]) + k - (int(self.upto[run - 1]) if run else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of the sorted members ``low``, each below 2^16."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(first) < min(2 * len(low), BITMAP):
        return RunContainer(low, first)
    return ArrayContainer(low) if 2 * len(low) <= BITMAP else BitmapContainer(low)


class BoundarySet:
    """A set of offsets, built by adding ever greater ones."""

    def __init__(self):
        self.keys: list[int] = []
        self.upto: list[int] = []
        self.containers: list = []
        self.open: list[np.ndarray] = []  # members of the container that isn't closed yet
        self.key = 0

    def _close(self) -> None:
        low = np.concatenate(self.open) if self.open else np.zeros(0, np.int64)
        if len(low):
            self.keys.append(self.key)
            self.containers.append(container(low))
            self.upto.append(len(self) + len(low))
        self.open = []

    def add(self, offsets: np.ndarray) -> None:
        high = offsets // SPAN
        for part in np.split(offsets, np.flatnonzero(np.diff(high)) + 1):
            if len(part):
                if (key := int(part[0]) // SPAN) != self.key:
                    self._close()
                    self.key = key
                self.open.append(part % SPAN)

    def close(self) -> BoundarySet:
        self._close()
        return self

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0, of a closed set."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        return SPAN * self.keys[at] + self.containers[at].select(k - (self.upto[at - 1] if at else 0))


def boundaries(buf: np.ndarray) -> BoundarySet:
    """Code-point offsets of the starts of the tokens ``[A-Za-z]+|[^A-Za-z]`` of a UTF-8 text, and its end, taken in pieces of ``kernels.CHUNK`` bytes."""
    out = BoundarySet()
    done, inside = 0, False  # code points before the piece; its last byte but one piece is a letter
    for at in range(0, len(buf), kernels.CHUNK):
        piece = buf[at : at + kernels.CHUNK]
        character = (piece & 0xC0) != 0x80
        letter = _LETTER[piece]
        start = character.copy()
        start[1:] &= ~(letter[1:] & letter[:-1])
        start[0] &= not (inside and letter[0])
        out.add(done + np.cumsum(character, dtype=np.int64)[start] - 1)
        done += int(np.count_nonzero(character))
        inside = bool(letter[-1])
    out.add(np.array([done], dtype=np.int64))
    return out.close()


@F.arrow_udf(StructType([StructField(name, LongType()) for name in ("n", "lo", "hi")]))
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    """Tokens of each text, and the smaller and the greater of the boundaries that the two numbers choose."""
    buf, off = kernels.utf8(text)
    out = np.zeros((3, len(text)), dtype=np.int64)
    for i, (a, b) in enumerate(zip(first.to_pylist(), second.to_pylist(), strict=True)):
        found = boundaries(buf[off[i] : off[i + 1]])
        lo, hi = sorted((a % len(found), b % len(found)))
        out[:, i] = len(found) - 1, found.select(lo), found.select(hi)
    return pa.StructArray.from_arrays(list(map(pa.array, out)), names=["n", "lo", "hi"])


def fill_in_middle(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text", cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``: each text of n tokens in the form ``plain``, ``psm`` or ``spm``.

    Where a text is cut and which form it takes depend on the seed and its id only, so rows that share an id draw the
    same numbers; a null id counts as an empty one. Null texts are empty. Empty texts, and those in which a mark stands
    already, stay plain; the two numbers of characters are null then. Row by row: repeated rows stay, an empty table
    gives an empty one, other columns are ignored. A text is held whole, its boundaries in pieces.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *(d.alias(f"h{k}") for k, d in enumerate(draw, 1)))
    rows = rows.withColumn("c", _cuts("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("c.n") == 0) | marked | (F.col("h3") % 100 >= cut)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    lo, hi = F.col("c.lo"), F.col("c.hi")
    prefix, middle, suffix = F.substring("text", F.lit(1), lo), F.substring("text", lo + 1, hi - lo), F.substring("text", hi + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    whole = F.col("form") == "plain"
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", F.col("c.n").alias("n"), "form", F.when(~whole, lo).alias("prefix_chars"), F.when(~whole, hi - lo).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` gave this output in this form; a cut output holds each mark once."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda *at: F.concat(*(F.get(parts, F.lit(i)) for i in at))
    return F.when(form == "plain", output).when(form == "psm", part(1, 3, 2)).otherwise(part(2, 3, 1))


def digests(rows: DataFrame) -> DataFrame:
    """Rows of ``fill_in_middle`` with hashes in place of the output: ``output_sha256``, and ``restored_sha256`` of the text rebuilt from it."""
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same in SQL.
SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
), h AS (
  SELECT *, len(tokens) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle, array_to_string(tokens[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
