import random

import pytest

from inkvane.llm import sampling

from tests.llm.conftest import record

TARGETS = [("label", "human", 5000, 5), ("label", "ai", 5000, 5), ("model_family", "m1", 8000, 1), ("model_family", "m2", 2000, 1), ("source", "big", 6000, 1), ("source", "small", 3000, 12), ("source", "none", 1000, 2), ("odd", "x", 100, 1)]
SCHEMA = "axis string, category string, share_bp int, min_count int"


def table(make, n=500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ai = i % 2
        rows.append(record(f"r{i:03}", None, label=["Human", " ai"][ai], family=["M1", "m2"][i % 3 == 0] if ai else None, source="Small" if i % 45 == 0 else rng.choice([" BIG", "big", None])))
    return make(rows + rows[:9])


def test_unmet(spark, make):
    df = table(make)
    got = {(r["axis"], r["category"]): (r["reached"], r["needed"]) for r in sampling.unmet(sampling.records_with_axes(df), spark.createDataFrame(TARGETS, SCHEMA)).collect()}
    assert got == {("source", "small"): (12, 30), ("source", "none"): (0, 10), ("odd", "x"): (0, 1)}


def test_draw(spark, make):
    df, targets = table(make), spark.createDataFrame(TARGETS, SCHEMA)
    out = sampling.draw(df, targets)
    rows = out.collect()
    assert len({r["id"] for r in rows}) == len(rows) and 100 <= len(rows) <= 114
    assert sum(r["source"] == "small" for r in rows) == 12  # the floor takes all there are
    share = sum(r["label"] == "human" for r in rows) / len(rows)
    assert share == pytest.approx(0.5, abs=0.08)
    assert {r["id"] for r in sampling.draw(df, targets).collect()} == {r["id"] for r in rows}
    rep = {(r["axis"], r["category"]): r["drawn"] for r in sampling.report(out, targets).collect()}
    assert rep["source", "none"] == 0 and rep["source", "small"] == 12


def test_nothing(spark, make):
    targets = spark.createDataFrame(TARGETS, SCHEMA)
    assert sampling.draw(make([]), targets).count() == 0
    assert sampling.unmet(sampling.records_with_axes(make([])), targets).count() == 8  # the minimum counts
    assert sampling.unmet(sampling.records_with_axes(table(make)), spark.createDataFrame([], SCHEMA)).count() == 0
    assert sampling.draw(make([record("a", None, label=None, source=None)] * 3), targets, divisor=1).count() == 1


def test_probabilities_meet_what_they_can():
    cells = [{"a": "x", "b": None, "count": 50}, {"a": "x", "b": "p", "count": 50}, {"a": "y", "b": "q", "count": 10}]
    take, left = sampling.fit_probabilities(cells, ["a", "b"], {("a", "x"): (0.5, 0), ("a", "y"): (0.5, 0)}, 30)
    assert take[2] == pytest.approx(10, abs=0.5) and all(t <= c["count"] + 1e-9 for t, c in zip(take, cells))


def test_contradicting_targets_are_named():
    cells = [{"a": "x", "b": "p", "count": 50}, {"a": "y", "b": "q", "count": 50}]
    _, left = sampling.fit_probabilities(cells, ["a", "b"], {("a", "x"): (0.9, 0), ("a", "y"): (0.1, 0), ("b", "p"): (0.2, 0), ("b", "q"): (0.8, 0)}, 20)
    assert left > 1
