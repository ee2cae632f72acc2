"""What workers hold at once, and simhashes of texts in slices."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleanery.functions import containers, scoring


def test_containers_take_pages_in_batches_of_bounded_bytes(spark):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    pages = spark.range(0, 3000, 1, 1).select("id", F.concat(F.lit("<article>"), F.repeat(F.lit("x"), 20_000), F.lit("</article>")).alias("html"), F.array(F.lit("article")).alias("selectors"))
    found = containers.article_containers(pages, "html", "selectors")
    sizes = found.select("id", "inner_html").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) > 3000 * 20_000 and max(r.n for r in sizes) < 20 << 20


def _plain(text: str) -> str:
    grams = [text[i : i + 4] for i in range(max(1, len(text) - 3))] if text else []
    sums = sum((np.unpackbits(np.frombuffer(hashlib.sha256(g.encode()).digest()[:8], np.uint8)).astype(int) * 2 - 1 for g in grams), np.zeros(64, int))
    return np.packbits(sums > 0).tobytes().hex()


def test_simhashes_of_slices(monkeypatch):
    wide = "".join(map(chr, [*range(0x21, 0xD000), *range(0x10000, 0x17000)]))
    texts = ["", "a", "abc", "abcd", "abcde" * 30_000, "猫が好き" * 9, wide, "", "xyz", "ab\0"]
    letters = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]

    def run(part):
        return [x.tobytes().hex() for x in scoring._simhash(np.concatenate(part), np.cumsum([len(x) for x in part]))]

    want = [_plain(x) for x in texts]
    assert run(letters) == want and [run([x])[0] for x in letters] == want
    taken, sha256 = [], hashlib.sha256
    monkeypatch.setattr(hashlib, "sha256", lambda x: taken.append(x) or sha256(x))
    assert run(letters[1:6]) == want[1:6] and not taken  # a worker remembers its shingles
