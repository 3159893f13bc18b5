import random

import pytest

from inkvane.llm import units

from tests.llm.conftest import record


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, g, p in rows:
        a = find(("r", i))
        for other in [("g", g.strip().lower().replace("_", "-").replace("/", "-"))] if g else []:
            parent[find(other)] = find(a)
        if p:
            parent[find(("r", p))] = find(("r", i))
    out = {}
    for i, _, _ in rows:
        out.setdefault(find(("r", i)), set()).add(i)
    return {i: min(c) for c in out.values() for i in c}


def rows_of(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice([None, None, f"g-{rng.randrange(30)}", f" G_{rng.randrange(30)} ", "hot"] if i % 3 else ["hot"])
        rows.append((f"r{i:03}", g, rng.choice([None, None, None, f"r{rng.randrange(n):03}", "gone-1"])))
    rows += [(f"c{i:02}", None, f"c{i - 1:02}") for i in range(1, 40)]  # a long chain
    return rows


def test_units(make):
    rows = rows_of(3)
    got = {r["id"]: r["unit_id"] for r in units.units(make([record(i, None, group=g, parent=p) for i, g, p in rows + rows[:5]])).collect()}
    assert got == components(rows)


def test_straddling(make):
    rows = rows_of(8)
    rng = random.Random(2)
    split = {i: rng.choice(["train", "Training ", "val", "dev", None]) for i, _, _ in rows}
    name = {"train": "train", "Training ": "train", "val": "val", "dev": "val", None: None}
    unit = components(rows)
    seen = {}
    for i, u in unit.items():
        seen.setdefault(u, set()).add(name[split[i]])
    want = {(i, u) for i, u in unit.items() if len(seen[u] - {None}) > 1}
    got = [tuple(r) for r in units.straddling(make([record(i, None, split[i], g, p) for i, g, p in rows])).collect()]
    assert set(got) == want and len(got) == len(want)


def test_assignment(spark, make):
    rng = random.Random(4)
    rows = [record(f"r{i:03}", None, group=f"g{i // rng.randint(1, 4)}", label=rng.choice(["human", "Ai ", "ai", None])) for i in range(400)]
    targets = spark.createDataFrame([("train", 7000), ("val", 1000), ("test", 2000)], "split string, share_bp int")
    out = units.assign_splits(make(rows), targets)
    got = out.collect()
    assert len(got) == 400
    per = {}
    for r in got:
        per.setdefault(r["unit_id"], set()).add(r["assigned"])
    assert all(len(s) == 1 for s in per.values())
    for r in units.split_report(out, targets).collect():
        assert abs(r["share"] - r["target"]) < 0.05


def test_nothing(spark, make):
    targets = spark.createDataFrame([("train", 7000)], "split string, share_bp int")
    assert units.straddling(make([])).count() == 0 and units.assign_splits(make([]), targets).count() == 0
    assert units.units(make([record(None, None, group="g")])).count() == 0
    assert [tuple(r)[:2] for r in units.units(make([record("a", None)])).select("id", "unit_id").collect()] == [("a", "a")]


def test_allocation_counts():
    classes = [{"kind": 1, "units": 1000, "n0": 1000, "n1": 0}, {"kind": 2, "units": 3, "n0": 0, "n1": 90}]
    plan = units.allocate(classes, ["n0", "n1"], {"train": 0.7, "val": 0.1, "test": 0.2})
    assert {k: sum(v.values()) for k, v in plan.items()} == {1: 1000, 2: 3}
    assert plan[1]["train"] == pytest.approx(700, abs=15)
