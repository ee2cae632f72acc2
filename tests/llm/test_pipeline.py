"""The pipeline's stages against brute force on a small folder of tables."""

import random

import corpus_pipeline
from gleanery.llm import linededup, quality, queries

from .common import edited, soup
from .test_models import labelled
from .test_near import brute_components, brute_lines, shingles


def folder(spark, path, texts, labels, items):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline(spark, tmp_path):
    texts, labels = labelled(260)
    rng = random.Random(1)
    items = [(k, " ".join(soup(5000 + k, 25))) for k in range(5)]
    line = " ".join(soup(6000, 14))
    for d in range(0, 260, 13):
        if labels[d][1]:
            texts[d] = texts[d] + "\n" + line
    for d in range(100, 105):
        texts[d] = " ".join(soup(7000 + d, 20)) + " " + items[d - 100][1]
    base = soup(8000, 120)
    texts += [" ".join(edited(base, 9000 + k, rng.randint(0, 3))) for k in range(8)] + [None, ""]
    sf = folder(spark, tmp_path, texts, [x[:3] for x in labels], items)

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept: dict[str, dict] = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(out := f"{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        if k < 4:
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(kept[name]) <= {r["doc_id"] for r in before.collect()}
    good = {r["doc_id"] for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert set(kept["quality_classifier"]) == good
    assert {d for d, q, *_ in labels if q} <= good
    source = [texts[d] if d in good else None for d in range(len(texts))]
    drop = brute_lines(source, linededup.LEAST, linededup.NEAR)
    lines = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[d]) for d, t in enumerate(source) if t is not None}
    lines |= {d: None for d in good if texts[d] is None}
    assert kept["line_dedup"] == {d: t for d, t in lines.items() if not drop[d] or t.strip()}
    order = sorted(kept["line_dedup"])
    groups = brute_components([kept["line_dedup"][d] for d in order])
    assert set(kept["ngram_jaccard_join"]) == {d for i, d in enumerate(order) if groups[i] == i}
    leaks = {d for d in kept["ngram_jaccard_join"] if any(t in (kept["ngram_jaccard_join"][d] or "") for _, t in items)}
    assert set(kept["benchmark_decontamination"]) == set(kept["ngram_jaccard_join"]) - leaks
    assert leaks
    assert {r["doc_id"] for r in docs.collect()} == set(kept["benchmark_decontamination"])
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_pipeline_of_nothing_repeated_rows_and_a_long_text(spark, tmp_path):
    texts, labels = labelled(60)
    items = [(0, " ".join(soup(5000, 25)))]
    none = folder(spark, tmp_path / "none", texts[:0], [x[:3] for x in labels], items)
    assert corpus_pipeline.run(spark, none).count() == 0
    good = [t for t, (_, q, *_) in zip(texts, labels, strict=True) if q]
    long = "\n".join(" ".join(soup(9000 + k, 12)) for k in range(6000))
    sf = folder(spark, tmp_path / "some", texts, [x[:3] for x in labels], items)
    extra = [(500, long), (501, long), (7, texts[7]), (7, texts[7]), (None, good[0]), (None, None)]
    more = [(d, t, None, None, None) for d, t in extra]
    spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    pieces = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == 500)
    assert len(pieces) > 20 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False))
    assert not any(r["doc_id"] == 501 for r in out)


def test_every_operator_takes_a_text_of_many_slices(spark, tmp_path):
    """One text of 6 MB, over the edges of chunks and slices, among short ones."""
    long = "\n".join(" ".join(soup(k % 997, 40)) for k in range(36_000))
    assert len(long.encode()) > 5_000_000
    texts = [long, "a short text", long[:3000], None]
    sf = folder(spark, tmp_path, texts, [(k, 1, 0) for k in range(3)], [(0, " ".join(soup(5000, 25)))])
    got = {name: {r["doc_id"]: r for r in query(spark, sf).collect()} for name, query in queries.queries().items() if name not in ("op6_best_fit_packing", "op10_substring_dedup", "op1_benchmark_decontamination", "op12_embedding_whitening")}  # the last one takes no texts
    assert all(len(rows) == 4 for rows in got.values())
    assert got["op2_media_columns"][0]["n_bytes"] == len(long.encode())
    assert got["op8_ngram_jaccard_join"][0]["n_shingles"] == len(shingles(long))
    assert got["op7_line_dedup"][0]["n_lines"] == 36_000 and got["op7_line_dedup"][0]["n_dropped"] >= 36_000 - 997
    pieces = [r for r in queries.op6_best_fit_packing(spark, sf).collect() if r["doc_id"] == 0]
    assert sum(r["length"] for r in pieces) == max(r["start"] + r["length"] for r in pieces) and all(r["length"] <= 2048 for r in pieces)
    assert any(r["doc_id"] == 2 and r["other_id"] == 0 for r in queries.op10_substring_dedup(spark, sf).collect())
    assert queries.op1_benchmark_decontamination(spark, sf).count() == 0
