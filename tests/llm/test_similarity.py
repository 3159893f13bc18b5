import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkvane.llm import codepoints as cp
from inkvane.llm import similarity, textform

from tests.llm.conftest import record, text


def runs(t):
    t = textform.compared(*cp.decode(pa.array([t]))[:2])
    s = cp.encode(*t, np.array([True])).to_pylist()[0]
    return s, {s[i : i + 8] for i in range(len(s) - 7)}


def brute(rows, threshold=0.5):
    docs = {}
    for i, t in rows:
        if i and t:
            s, r = runs(t)
            if len(s) >= 60:
                docs[i] = r
    ids = sorted(docs)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(docs[a] & docs[b]) >= threshold * len(docs[a] | docs[b])}


def corpus(seed=2, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = text(rng)
        rows.append((f"d{i:03}", base))
        for k in range(rng.randint(0, 3)):
            words = base.split(" ")
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(len(words))] = rng.choice(["qua", "zo", "", "Wixel"])
            if k == 2:
                words = words[len(words) // 3 :] + words[: len(words) // 3]
            rows.append((f"d{i:03}v{k}", " ".join(words)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper()), ("short", "Too short."), ("null", None), ("empty", ""), (None, rows[0][1]), ("copy1", rows[0][1])]
    return rows


def test_pairs_against_brute_force(make):
    rows = corpus()
    got = [tuple(r) for r in similarity.near_duplicate_pairs(make([record(i, t) for i, t in rows])).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) > 60


def test_groups(make):
    rows = corpus(5, 25)
    pairs = brute(rows)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: (r["class_id"], r["links"]) for r in similarity.groups(make([record(i, t) for i, t in rows])).collect()}
    assert "short" not in got and "null" not in got
    for i, (c, n) in got.items():
        assert c == find(i) and n == sum(i in p for p in pairs)


def test_the_exact_way(make):
    rows = corpus(13, 40)
    df = make([record(i, t) for i, t in rows])
    for threshold in (0.3, 0.6):
        got = [tuple(r) for r in similarity.near_duplicate_pairs(df, threshold=threshold, exact=True).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)
    with pytest.raises(ValueError):
        similarity.near_duplicate_pairs(df, threshold=0.3)


def test_nothing(make):
    assert similarity.near_duplicate_pairs(make([])).count() == 0
    assert similarity.groups(make([record("a", "x")])).count() == 0


def test_a_hot_group_of_copies(make):
    t = text(random.Random(4))
    rows = [record(f"c{i:03}", t) for i in range(60)] + [record(f"o{i}", text(random.Random(100 + i))) for i in range(60)]
    assert similarity.near_duplicate_pairs(make(rows)).count() == 60 * 59 // 2
    assert similarity.class_links(make(rows)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**35 - 1), st.integers(0, 2**32 - 2)), min_size=1, max_size=200))
def test_packing(items):
    items.sort()
    key, doc = np.array([a for a, _ in items], np.uint64), np.array([b for _, b in items], np.uint32)
    k, d = similarity.unpack(similarity.pack(key, doc))
    assert (k == key).all() and (d == doc).all()


def test_bit_counts_never_hide_a_pair():
    rng = random.Random(9)
    a = [text(rng) for _ in range(40)]
    b = [" ".join(w if rng.random() < rng.choice([0.9, 0.97]) else "zzq" for w in t.split()) for t in a]
    forms = [pa.array([runs(t)[0] for t in x], pa.string()) for x in (a, b)]
    got = similarity._jaccard(*forms, 0.5)
    for s, x, y in zip(got, a, b):
        p, q = runs(x)[1], runs(y)[1]
        j = len(p & q) / len(p | q)
        assert s == pytest.approx(j) if j >= 0.5 else s < 0.5


def test_samples_estimate_similarity():
    rng = random.Random(3)
    a = text(rng, 20)
    b = " ".join(w if i % 9 else "qqq" for i, w in enumerate(a.split()))
    cps, off = textform.compared(*cp.decode(pa.array([a, b]))[:2])
    mins, _ = similarity._mins(cps, off)
    p, q = runs(a)[1], runs(b)[1]
    assert abs((mins[0] == mins[1]).mean() - len(p & q) / len(p | q)) < 0.15
