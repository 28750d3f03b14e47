import numpy as np
import pytest

from scanframe.llm import whitening
from scanframe.llm.common import table

DDL = "vec_id long, embedding array<float>, x int, component string"


def _brute(rows):
    """(n, {vec_id: deviation}, whitened by |value|, explained) from a covariance matrix."""
    x = {k: np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for k, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    deviation = {k: sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True)) for k, v in x.items()}
    return n, deviation, {k: np.abs((v - s / n) @ vectors / np.sqrt(values)) for k, v in x.items()}, values / centred.var(0).sum()


def test_against_a_covariance_matrix(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    n, deviation, whitened, explained = _brute(rows)
    found = whitening.op12_whitening(spark, sf).collect()
    assert len(found) == 16 * len(rows)
    for r in found:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.whitened) == pytest.approx(whitened[r.vec_id][r.component - 1], abs=1e-6)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_the_tree_of_many_parts_and_short_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=5) * [9, 5, 3, 1, 0.5] + 7).tolist(), 0, "") for k in range(300)]
    found = whitening.whiten(spark.createDataFrame(rows, DDL).repartition(70)).collect()
    n, deviation, whitened, explained = _brute([(k, np.array(v, np.float32)) for k, v, *_ in rows])
    assert len(found) == 5 * 300  # fewer dimensions than components
    for r in found:
        assert abs(r.whitened) == pytest.approx(whitened[r.vec_id][r.component - 1], abs=1e-8)
        assert r.deviation == deviation[r.vec_id]
    # a sign is the same for all rows
    signed = {(r.vec_id, r.component): r.whitened for r in found}
    assert abs(sum(signed[k, 1] for k in range(300))) < 1e-6


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, "a"), (2, [0.0, 1.0], 0, "a"), (2, [0.0, 1.0], 0, "a"), (None, [0.0, 0.0], 0, "a"), (4, None, 0, "a"), (5, [None, 1.0], 0, "a"), (6, [nan, 1.0], 0, "a"),
        (7, [inf, 1.0], 0, "a"), (8, [], 0, "a"), (9, [1.0, 2.0, 3.0], 0, "a"), (10, [3e38, 0.0], 0, "a"),
    ]
    found = whitening.whiten(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (2, 2)]
    assert {r.n for r in found} == {3}
    assert {r.vec_id: r.deviation for r in found} == {1: 64**2 * 5, 2: 64**2 * 5, None: 64**2 * 2}
    assert whitening.whiten(spark.createDataFrame([], DDL)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[4:8], DDL)).count() == 0


def test_components_without_variance(spark):
    found = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, ""), (2, [3.0, 2.0], 0, "")], DDL)).collect()
    assert {(r.vec_id, r.component): (r.whitened if r.whitened is None else round(r.whitened, 9)) for r in found} == {(1, 1): -1.0, (2, 1): 1.0, (1, 2): None, (2, 2): None}
    assert {r.component: r.explained for r in found} == {1: pytest.approx(1.0), 2: 0.0}
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, "")] * 3, DDL)).collect()
    assert len(alone) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone} == {(1, 0, None, None, None)}


def test_numbers_too_large_for_64_bits():
    centre = whitening.Centre(2**40, np.array([5], np.int64), np.array([3], np.int64))
    x = np.array([[2**40], [5]], np.int64)
    assert centre.deviations(x).tolist() == [[2**40 * (2**40 - 5) - 3], [-3]]


def test_large_entries(spark):
    found = whitening.whiten(spark.createDataFrame([(1, [2.0**49], 0, ""), (2, [-(2.0**49)], 0, ""), (3, [0.0], 0, "")], DDL)).collect()
    assert {r.vec_id: r.deviation for r in found} == {1: None, 2: None, 3: 0}
    assert [round(r.whitened, 6) for r in sorted(found, key=lambda r: r.vec_id)] in ([1.224745, -1.224745, 0.0], [-1.224745, 1.224745, 0.0])
