"""Criteria, scores, hashes and fingerprints as Column expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.config import CONFIG, CRITERIA, LABELS, Config
from gleanery.functions import unicode


def content_hash(title: Column, excerpt: Column) -> Column:
    return F.substring(F.sha2(F.concat(title, F.lit("\0"), F.coalesce(excerpt, F.lit(""))), 256), 1, 16)


def curation_signature(version: str, model: str) -> Column:
    return F.substring(F.sha2(F.lit(f"v{version}\0{model}"), 256), 1, 16)


def valid_json(text: Column) -> Column:
    """A whole JSON object; text after it doesn't pass."""
    return F.coalesce(F.try_parse_json(text).isNotNull() & F.rtrim(text).endswith("}"), F.lit(False))


def _raw(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def level(json: Column, key: str) -> Column:
    """The ranking form: numbers as they are, true as 1, anything else 0."""
    raw = _raw(json, key)
    return F.coalesce(F.when(raw == "true", 1.0).otherwise(raw.try_cast("double")), F.lit(0.0))


def usefulness(json: Column, config: Config = CONFIG) -> Column:
    """The score of a criteria text; missing or invalid JSON has the neutral one."""
    first, ceremony, specific, day = (level(json, k) for k in CRITERIA[:4])
    heavy = (_raw(json, "promotional") == "heavy") | (level(json, "promotional") >= config.promotional_from)
    points = (
        F.when((ceremony >= 1) & (day >= 1), config.gate_points).otherwise(0)
        + config.ceremony_weight * ceremony + config.firsthand_weight * first + config.specific_weight * specific + config.day_weight * day
        - F.when(heavy, config.promotional_penalty).otherwise(0)
    )
    return F.when(json.isNull() | ~valid_json(json), float(config.no_criteria_score)).otherwise(points)


def usefulness_sql(column: str, config: Config = CONFIG) -> str:
    """The same score as Spark SQL text, for views and ORDER BY clauses."""
    level_of = lambda k: f"coalesce(CASE WHEN get_json_object({column}, '$.{k}') = 'true' THEN 1.0D ELSE try_cast(get_json_object({column}, '$.{k}') AS DOUBLE) END, 0.0D)"
    first, ceremony, specific, day = map(level_of, CRITERIA[:4])
    heavy = f"coalesce(get_json_object({column}, '$.promotional') = 'heavy', false) OR {level_of('promotional')} >= {config.promotional_from}"
    points = f"CASE WHEN {ceremony} >= 1 AND {day} >= 1 THEN {config.gate_points} ELSE 0 END + {config.ceremony_weight} * {ceremony} + {config.firsthand_weight} * {first} + {config.specific_weight} * {specific} + {config.day_weight} * {day} - CASE WHEN {heavy} THEN {config.promotional_penalty} ELSE 0 END"
    return f"CASE WHEN {column} IS NULL OR try_parse_json({column}) IS NULL OR NOT endswith(rtrim({column}), '}}') THEN {float(config.no_criteria_score)}D ELSE {points} END"


def gate_passed(json: Column) -> Column:
    return valid_json(json) & (level(json, "ceremonyDecision") >= 1) & (level(json, "weddingDayContent") >= 1)


def display_levels(json: Column) -> Column:
    """The display form, a struct of five levels 0 to 9; NULL if the JSON is bad or a key isn't number, boolean or text."""

    def clamp(raw: Column) -> Column:
        return F.when(raw == "true", 9).when(raw == "false", 0).otherwise(F.least(F.lit(9), F.greatest(F.lit(0), F.floor(raw.try_cast("double")).cast("int"))))

    levels = [F.coalesce(clamp(_raw(json, k)), F.lit(0)).alias(k) for k in CRITERIA[:4]]
    p = _raw(json, "promotional")
    levels.append(F.coalesce(F.when(p == "heavy", 9).when(p == "light", 4).when(p == "none", 0).when(p == "true", 4).otherwise(clamp(p)), F.lit(0)).alias("promotional"))
    complete = F.lit(True)
    for k in CRITERIA:
        complete = complete & _raw(json, k).isNotNull()
    return F.when(valid_json(json) & complete, F.struct(*levels))


def rationale(anchor: Column, levels: Column, config: Config = CONFIG) -> Column:
    """The template sentence for an anchor and the labels that reach the level; NULL if its length is out of bounds."""
    labels = F.array_compact(F.array(*(F.when(levels[k] >= config.label_level, text) for k, text in LABELS)))
    head = F.concat(F.lit("「"), anchor, F.lit("」に関する記事"))
    text = F.when(F.size(labels) == 0, F.concat(head, F.lit("です。自動判定では特筆すべき特徴は検出されませんでした。"))).otherwise(F.concat(head, F.lit("で、"), F.array_join(labels, "、"), F.lit("という特徴が自動判定されました。")))
    return F.when(F.length(text).between(config.rationale_min, config.rationale_max), text)


#: Letters whose shingles are hashed together: about 50 MB of arrays.
SIMHASH_LETTERS = 200_000
#: Shingles whose digests a worker remembers at most: about 50 MB.
SIMHASH_KNOWN = 250_000
_KNOWN: dict[str, bytes] = {}

#: For each byte its bits as eight counters of 16 bits, the first bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint16)
#: Rows whose counters add up without overflow.
_ADDED = 65_535


def _digests(shingles: list[str]) -> np.ndarray:
    """The first eight bytes of the SHA-256 of each shingle, a row each; those that are known aren't taken again."""
    raw = []
    for x in shingles:
        digest = _KNOWN.get(x)
        if digest is None:
            if len(_KNOWN) >= SIMHASH_KNOWN:
                _KNOWN.clear()
            digest = _KNOWN[x] = hashlib.sha256(x.encode()).digest()[:8]
        raw.append(digest)
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 8)


def _simhash(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Simhashes of texts given as UTF-32 letters without blanks, one text after another up to each of ``ends``. Each distinct shingle of the batch is looked up once."""
    if not len(letters):
        return np.zeros((len(ends), 8), np.uint8)
    sizes = np.diff(ends, prepend=0)
    starts = ends - sizes
    doc = np.repeat(np.arange(len(ends)), sizes)
    place = np.arange(len(letters)) - starts[doc]
    at = np.flatnonzero((place <= sizes[doc] - 4) | (place == 0))  # all of a short text is its one shingle
    doc = doc[at]
    # letters by rank, 0 beyond a short text's end; four ranks are a number
    present = np.zeros(0x110000, bool)
    present[letters] = True
    rank = np.append(np.cumsum(present, dtype=np.uint32)[letters], np.zeros(3, np.uint32)).astype(np.uint64)
    parts = [np.where(at + k < ends[doc], rank[at + k], np.uint64(0)) for k in range(4)]
    if int(rank.max()) < 1 << 16:
        keys = (parts[0] << np.uint64(48)) | (parts[1] << np.uint64(32)) | (parts[2] << np.uint64(16)) | parts[3]
    else:
        pairs = np.unique(np.concatenate([(a << np.uint64(21)) | b for a, b in (parts[:2], parts[2:])]), return_inverse=True)[1].astype(np.uint64)
        keys = (pairs[: len(at)] << np.uint64(32)) | pairs[len(at) :]
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    text = letters.tobytes().decode("utf-32-le")
    ones = _SPREAD[_digests([text[i:j] for i, j in zip(at[first].tolist(), np.minimum(at[first] + 4, ends[doc[first]]).tolist(), strict=True)])]
    ones = ones.reshape(-1, 64).view(np.uint64)  # four counters are added at once
    n = np.bincount(doc, minlength=len(ends))
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    begin = np.union1d(begin, np.arange(0, len(doc), _ADDED))
    sums = np.add.reduceat(ones[inverse], begin, axis=0).view(np.uint16).astype(np.int64)
    out = np.zeros((len(ends), 64), np.int64)
    np.add.at(out, doc[begin], sums)
    return np.packbits(2 * out > n[:, None], axis=1)


@F.arrow_udf(StringType())
def _simhashes(bare: pa.Array) -> pa.Array:
    texts = [np.frombuffer((x or "").encode("utf-32-le"), np.uint32) for x in bare.to_pylist()]
    out, begin = [], 0
    while begin < len(texts):
        stop, held = begin + 1, len(texts[begin])
        while stop < len(texts) and held + len(texts[stop]) <= SIMHASH_LETTERS:
            held += len(texts[stop])
            stop += 1
        part = texts[begin:stop]
        out += [h.tobytes().hex() for h in _simhash(np.concatenate(part), np.cumsum([len(x) for x in part]))]
        begin = stop
    return pa.array(out, pa.string())


def simhash(text: Column) -> Column:
    """64 bits over 4-character shingles of the text without blanks, weighed by occurrence; no shingles: zeros.

    In Arrow batches: a shingle's SHA-256 is taken once for each slice of texts, and nothing is shuffled. A text longer
    than ``SIMHASH_LETTERS`` is a slice of its own.
    """
    return _simhashes(unicode.without_blanks(F.coalesce(text, F.lit(""))))


def simhash64(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, simhash)`` of each row."""
    return df.select(key, simhash(F.col(text)).alias("simhash"))


def simhash_similarity(a: Column, b: Column) -> Column:
    """1 - hamming / 64; 0 unless both are 16 hex digits."""
    ok = F.coalesce(a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$"), F.lit(False))
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    distance = sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))
    return F.when(ok, 1 - distance / 64).otherwise(0.0)
