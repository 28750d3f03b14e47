"""Rows that repeat take one place among a query's nearest, however many they are."""

import numpy as np
from test_ann import brute, check

from scanframe.llm import ann


def test_many_repeats_beside_a_query(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 400)]
    rows += [(1000, [1.0, 2.0, 3.0, 4.0])] + [(1001, [1.0, 2.0, 3.0, 4.01])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert len(want[1000]) == 10
    check(ann.search(df, recall=1.0).collect(), want, 1.0)


def test_repeats_do_not_fill_the_share_to_probe(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(1, 600)]
    rows += [(1000, [0.5, 0.5, 0.5, 0.5])] + [(1001, [0.5, 0.5, 0.5, 0.51])] * 5000
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = ann.search(df).filter("query_id = 1000").collect(), brute(rows)[1000]
    assert len(got) == 10 and len({r.vec_id for r in got} & {i for _, i in want}) >= 8


def test_a_task_keeps_pairs_once(spark):
    pairs = [(np.array([7]), [0.0, 0.0], np.array([5] * 30 + list(range(20, 40))), [[1.0, 0.0]] * 30 + [[2.0 + k, 0.0] for k in range(20)])]
    index = ann.MultiIndex(np.zeros((1, 1)), np.zeros((1, 1)), 2)
    one = np.zeros(1, np.int32)
    rows = [(q.astype(np.int64), np.array(v), one + 1, one, np.zeros(len(i), np.int32), i.astype(np.int64), np.array(x)) for q, v, i, x in pairs]
    names = ("query_ids", "queries", "visits", "visited", "cells", "ids", "vectors")
    joined = spark.createDataFrame([tuple(bytearray(c.tobytes()) for c in r) for r in rows], ", ".join(f"{n} binary" for n in names))
    got = sorted(ann._ranked(joined, index, 10).toArrow().column("vec_id").to_pylist())
    assert got == [5, *range(20, 29)]
