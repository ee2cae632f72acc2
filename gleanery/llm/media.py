"""Media columns: what a blob really holds, told from its bytes.

An Aho-Corasick automaton finds every place where a known format's magic bytes stand; a validator for the
format then reads the structure from there and gives the length, or rejects the place. The first valid
place at offset 0 is the blob's type (whatever was declared); valid places inside foreign bytes are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Magic bytes of public formats, with the offset from the start of the file at which they stand.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "image/gif": (b"GIF8", 0),
    "image/bmp": (b"BM", 0),
    "image/x-portable-graymap": (b"P5", 0),
    "image/x-portable-pixmap": (b"P6", 0),
    "audio/wav": (b"WAVE", 8),
    "image/webp": (b"WEBP", 8),
    "audio/flac": (b"fLaC", 0),
    "application/ogg": (b"OggS", 0),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
}


def _png(b: bytes, at: int, marks: dict) -> int:
    p, seen = at + 8, False
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if not seen and kind != b"IHDR" or p + 12 + n > len(b):
            return 0
        if zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        seen, p = True, p + 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: bytes, at: int, marks: dict) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if kind == 0xDA:  # entropy-coded data up to the end marker
            end = _next(b, b"\xff\xd9", p + 2 + n, marks)
            return end + 2 - at if end >= 0 else 0
        if not (0xC0 <= kind <= 0xFE) or n < 2:
            return 0
        p += 2 + n
    return 0


def _gif(b: bytes, at: int, marks: dict) -> int:
    if b[at + 4 : at + 6] not in (b"7a", b"9a") or at + 13 > len(b):
        return 0
    flags, p = b[at + 10], at + 13
    p += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x2C:
            if p + 10 > len(b):
                return 0
            flags = b[p + 9]
            p += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
        elif b[p] == 0x21:
            p += 2
        else:
            return 0
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return 0


def _bmp(b: bytes, at: int, marks: dict) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or at + size > len(b):
        return 0
    return size if start + (width * bits + 31) // 32 * 4 * abs(height) <= size else 0


def _pnm(b: bytes, at: int, marks: dict) -> int:
    fields, p = [], at + 2
    while len(fields) < 3 and p < len(b):
        if b[p : p + 1].isspace():
            p += 1
        elif b[p : p + 1].isdigit():
            q = p
            while q < len(b) and q - p < 10 and b[q : q + 1].isdigit():
                q += 1
            fields.append(int(b[p:q]))
            p = q
        else:
            return 0
    if len(fields) < 3 or not b[p : p + 1].isspace() or not 0 < fields[2] < 65536 or not fields[0] * fields[1]:
        return 0
    end = p + 1 + fields[0] * fields[1] * (3 if b[at + 1] == 0x36 else 1) * (2 if fields[2] > 255 else 1)
    return end - at if end <= len(b) else 0


def _riff(b: bytes, at: int, marks: dict) -> int:
    if at + 20 > len(b) or b[at : at + 4] != b"RIFF":
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    p = at + 12
    while p + 8 <= at + size:  # the chunks have to fill the form
        p += 8 + (struct.unpack_from("<I", b, p + 4)[0] + 1) // 2 * 2 if p + 8 <= len(b) else len(b)
    return size if p == at + size and at + size <= len(b) else 0


def _flac(b: bytes, at: int, marks: dict) -> int:
    p = at + 4
    while p + 4 <= len(b):
        last, n = b[p] >> 7, int.from_bytes(b[p + 1 : p + 4], "big")
        if p == at + 4 and (b[p] & 0x7F or n != 34):
            return 0
        p += 4 + n
        if last:
            return len(b) - at if p <= len(b) else 0
    return 0


def _ogg(b: bytes, at: int, marks: dict) -> int:
    p = at
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        n = b[p + 26]
        p += 27 + n + sum(b[p + 27 : p + 27 + n])
    return p - at if at < p <= len(b) else 0


def _pdf(b: bytes, at: int, marks: dict) -> int:
    """Up to the last end mark before the next document's header: a file that was added to has several."""
    if not b[at + 5 : at + 6].isdigit() or _next(b, b"%%EOF", at, marks) < 0:
        return 0
    stop = _next(b, b"%PDF-", at + 5, marks)
    end = b.rfind(b"%%EOF", at, stop if stop >= 0 else len(b))
    return end + 5 - at if end >= 0 else 0


def _zip(b: bytes, at: int, marks: dict) -> int:
    end = _next(b, b"PK\x05\x06", at, marks)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def _next(b: bytes, mark: bytes, at: int, marks: dict) -> int:
    """``b.find(mark, at)``; ``marks`` keeps what was found, so that many searches for one mark read the blob once."""
    since, found = marks.get(mark, (len(b) + 1, 0))
    if not since <= at or 0 <= found < at:
        since, found = marks[mark] = (at, b.find(mark, at))
    return found


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "image/x-portable-graymap": _pnm, "image/x-portable-pixmap": _pnm,
    "audio/wav": _riff, "image/webp": _riff, "audio/flac": _flac, "application/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip,
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, (magic, offset) in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (kind, offset + len(magic) - 1))
    out.make_automaton()
    return out


def carve(blob: bytes) -> list[tuple[str, int, int]]:
    """``(type, offset, length)`` of each valid medium, by offset; one inside another isn't told apart."""
    out, free, marks = [], 0, {}
    for end, (kind, back) in _automaton().iter(blob.decode("latin-1")):
        at = end - back
        if at >= free and (n := VALIDATORS[kind](blob, at, marks)):
            out.append((kind, at, n))
            free = at + n
    return out


SNIFFED = "sniffed string, declared string, corrected boolean, spans array<struct<type:string,offset:long,length:long>>"


def sniff(df: DataFrame, blob: str, declared: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``blob`` of ``df``, with what the blob holds.

    ``sniffed``: the type of the medium at offset 0, else of the first carved one, else
    ``application/octet-stream``; null for a null blob. ``corrected``: it isn't the declared type (null
    counts as another type). ``spans``: all media found. Row by row, any order, repeated rows stay; an empty table
    gives no rows. Kept columns that bear the name of a new one are an error.
    """
    if taken := {"sniffed", "declared", "corrected", "spans"} & {c.lower() for c in (*keep, blob)}:
        raise ValueError(f"columns with the names of new ones: {sorted(taken)}")
    df = df.select(*keep, blob, F.col(declared).alias("_declared"))
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep, blob).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            declared = batch.column(batch.num_columns - 1).to_pylist()
            types, fixed, spans = [], [], []
            for b, said in zip(batch.column(len(keep)), declared, strict=True):
                found = None if b.as_py() is None else carve(b.as_py())
                got = None if found is None else found[0][0] if found else "application/octet-stream"
                types.append(got)
                fixed.append(None if got is None else got != said)
                spans.append(None if found is None else [dict(zip(("type", "offset", "length"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(types, pa.string()), pa.array(declared, pa.string()), pa.array(fixed, pa.bool_()), pa.array(spans, kind)],
                names=[*batch.schema.names[:-1], "sniffed", "declared", "corrected", "spans"],
            )

    return df.mapInArrow(run, f"{base}, {SNIFFED}")


WIDTH = 64


def _store(payload: bytes, pick: int) -> bytes:
    """The payload as 8-bit samples of one of four lossless formats, 64 samples a row."""
    rows = len(payload) // WIDTH
    if pick == 0:
        return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    if pick == 1:
        return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload
    if pick == 2:
        grey = b"".join(bytes((i, i, i, 0)) for i in range(256))
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + 1024 + len(payload), 0, 54 + 1024, 40, WIDTH, -rows, 1, 8, 0, len(payload), 0, 0, 256, 0) + grey + payload
    lines = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines, 1)), (b"IEND", b""))
    return MAGIC["image/png"][0] + b"".join(struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x)) for k, x in chunks)


def samples(medium: bytes, kind: str) -> bytes:
    """The 8-bit samples of a medium that ``store`` wrote."""
    if kind == "audio/wav":
        at = 12
        while medium[at : at + 4] != b"data":
            at += 8 + (struct.unpack_from("<I", medium, at + 4)[0] + 1) // 2 * 2
        return medium[at + 8 : at + 8 + struct.unpack_from("<I", medium, at + 4)[0]]
    if kind == "image/x-portable-graymap":
        return medium[medium.index(b"\n255\n") + 5 :]
    if kind == "image/bmp":
        return medium[struct.unpack_from("<I", medium, 10)[0] :]
    data, p = b"", 8
    while p < len(medium):
        n, name = struct.unpack_from(">I4s", medium, p)
        data += medium[p + 8 : p + 8 + n] if name == b"IDAT" else b""
        p += 12 + n
    lines = zlib.decompress(data)
    return b"".join(lines[i + 1 : i + 1 + WIDTH] for i in range(0, len(lines), WIDTH + 1))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, medium, declared)``: each text (null: empty) as UTF-8, padded with zeros to a positive multiple of 64, in a medium.

    The format (WAV, PGM, BMP or PNG) and the declared type, wrong for half of the texts, follow from
    the payload's SHA-256, so equal texts are equal media.
    """
    kinds = ("audio/wav", "image/x-portable-graymap", "image/bmp", "image/png")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):  # media are as large as texts
                n, media, declared = [], [], []
                for x in part.column(1):
                    raw = (x.as_py() or "").encode()
                    payload = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
                    digest = hashlib.sha256(payload).digest()
                    n.append(len(raw))
                    media.append(_store(payload, digest[0] % 4))
                    declared.append(kinds[(digest[0] + digest[1] % 2) % 4])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary()), pa.array(declared, pa.string())], names=["doc_id", "n_bytes", "medium", "declared"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, medium binary, declared string")


def digests(sniffed: DataFrame) -> DataFrame:
    """What the stored bytes give when read back; expects ``sniff(store_texts(...), "medium", "declared", ["doc_id", "n_bytes"])``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for blob, kind, corrected, spans in zip(batch["medium"], batch["sniffed"].to_pylist(), batch["corrected"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                span = spans[0]
                medium = blob.as_py()[span["offset"] : span["offset"] + span["length"]]
                payload = samples(medium, kind)
                feature = f"{kind};corrected={int(corrected)};" + ",".join(f"{x['offset']}+{x['length']}" for x in spans)
                for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(medium), hashlib.sha256(medium).hexdigest(), feature), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", *names])

    return sniffed.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
