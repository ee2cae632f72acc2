"""The driver contract with the subpackage present: all its queries are registered."""

import corpus_pipeline
from gleanery.llm import queries


def test_the_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert names >= set(queries.queries()) | {"pipeline"}
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
