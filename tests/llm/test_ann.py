"""The multi-index against brute force."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scanframe.llm import ann


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0 and q not in out:
            d = sorted((math.sqrt(((x - v) ** 2).sum()), i) for i, x in good if i != q)
            out[q] = list(dict.fromkeys(d))[:k]
    return out


def check(got, want, least):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {q for q, d in want.items() if d}
    hits = total = 0
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) == len(want[q])
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        truth = dict((i, d) for d, i in want[q])
        hits += sum(r.vec_id in truth for r in rows)
        total += len(truth)
        assert all(abs(truth[r.vec_id] - r.score) < 1e-12 for r in rows if r.vec_id in truth)
    assert hits >= least * total


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    check(ann.search(df).collect(), brute([(r.vec_id, r.embedding) for r in df.collect()]), 0.9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(450)]
    rows += [(1000, None), (1100, []), (1200, [0.0, 0.0, 0.0]), (1300, [1.0, None, 1.0]), (1400, [nan, 1.0, 1.0]), (1500, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (1600, [1.0, 2.0])]
    rows += [(100, [2.0, 1.0, 1.0]), (7, [0.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, cell int")
    got = ann.search(df, recall=1.0).collect()
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400} and len(got) == 50
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 3])
    for r in got:
        if r.query_id != 100:
            assert (r.score, r.vec_id) == want[r.query_id][r["rank"] - 1]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id in (100, 1000)").limit(1)).count() == 0


def test_hot_cell_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_IN_PART", 50)
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(k, [1.0, 2.0, 3.0, 4.0] if k % 3 == 0 else rng.normal(size=4).tolist()) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(ann.search(df, recall=1.0).collect(), brute(rows), 1.0)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 1000))
def test_pairs_come_by_summed_distance(k1, k2, seed):
    rng = np.random.default_rng(seed)
    index = ann.MultiIndex(rng.normal(size=(k1, 2)), rng.normal(size=(k2, 2)), 4)
    index.population[:] = rng.integers(0, 3, (k1, k2))
    x = rng.normal(size=4)
    found = index.probe(x, math.inf)
    cost = [((index.first[c // k2] - x[:2]) ** 2).sum() + ((index.second[c % k2] - x[2:]) ** 2).sum() for c in found]
    assert cost == sorted(cost) and set(found) == set(np.flatnonzero(index.population.reshape(-1)).tolist())
