"""Rounds of the components broadcast nothing: a driver keeps what it broadcasts for a while, and rounds are many."""

from gleanery.llm import components
from gleanery.llm.stages import Scratch


def test_rounds_without_broadcasts(spark, monkeypatch):
    plans, write = [], Scratch.write

    def watched(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31), (40, 40)], "a long, b long")
    monkeypatch.setattr(Scratch, "write", watched)
    found = sorted(map(tuple, components.components(links).collect()))
    assert found == [(k, 0) for k in range(21)] + [(30, 30), (31, 30), (40, 40)]
    rounds = [p for name, p in plans if name == "links"]
    assert len(rounds) > 2 and not any("BroadcastHashJoin" in p for p in rounds)
