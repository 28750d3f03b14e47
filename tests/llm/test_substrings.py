"""Substring dedup against a plain version."""

import random
import re

import numpy as np
import pytest

from scanframe.llm import substrings
from scanframe.llm.common import WORD


def plain(rows, window=13):
    words = [(i, re.findall(WORD, t or "")) for i, t in rows]
    rank = lambda i: float("inf") if i is None else i
    first = {}
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            g = tuple(ws[k : k + window])
            first[g] = min(first.get(g, float("inf")), rank(i))
    out = []
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < rank(i):
                gone.update(range(k, k + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(50)] + ["é", "x\x85y", " "]
    passages = [[rng.choice(pool) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    made = []
    for i in range(120):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p))
            text += p[a:] + [rng.choice(pool) for _ in range(rng.randint(0, 5))]
        made.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(text)))
    same = "one two three four five six seven eight nine ten eleven twelve thirteen"
    return made + [(1, None), (2, ""), (3, " \n"), (4, same), (4, same), (None, same), (None, same + " x"), (5, same + " " + same), (6, "a " * 500), (7, "a " * 20_000), (8, same.replace("one", "1"))]


@pytest.mark.parametrize("block_bytes", [1, 3000, 1 << 20])
def test_against_plain(spark, block_bytes):
    data = rows() if block_bytes > 1 else rows()[::3]
    df = spark.createDataFrame([(i, t, "b", 1, 2) for i, t in data], "doc_id long, text string, block string, key int, n_words int")
    got = substrings.drop_repeats(df, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == plain(data)


def test_locator_spells_any_number_of_words(monkeypatch):
    monkeypatch.setattr(substrings, "LETTERS", 2)
    rng = np.random.default_rng(2)
    words = rng.integers(0, 400, 3000)
    found = {tuple(words[a : a + 3].tolist()): a for a in range(0, 2990, 7)}
    locator = substrings.Locator(found)
    got = set(locator.matches(locator.spelled(words)))
    want = {(k + 2, found[g]) for k in range(2998) if (g := tuple(words[k : k + 3].tolist())) in found}
    assert got == want and 4 < locator.letters < 10


def test_empty_and_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert substrings.drop_repeats(docs.limit(0)).count() == 0
    found = substrings.drop_repeats(docs)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2  # documents are shuffled once
