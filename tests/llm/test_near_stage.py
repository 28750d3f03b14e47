"""The near-dedup stage of the pipeline: five-word shingles, Jaccard similarity of 0.8 or more."""

import random

import numpy as np

import corpus_pipeline
from scanframe.llm import exact_dedup, simhash


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest id of each component, from all pairs."""
    sets, parent = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            either = len(sets[a] | sets[b])
            if not either or len(sets[a] & sets[b]) / either >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted(least.values())


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 30, 200, 900]))]
        rows.append((i, " ".join(words)))
        for k in range(3):  # copies with more and more words replaced, on both sides of 0.8
            changed = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * (k + 1) // 80)):
                changed[at] = f"n{rng.randrange(10**6)}"
            rows.append((1000 * (k + 1) + i, " ".join(changed)))
    chain = [f"c{k}" for k in range(100)]
    rows += [(5000 + k, " ".join(chain[k * 8 :] + [f"e{j}" for j in range(k * 8)])) for k in range(6)]
    rows += [(6000, ""), (6001, None), (6002, "one"), (6003, "One"), (6004, "two"), (6005, "a b c d"), (6006, "a b c e")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int")
    left = corpus_pipeline.near(spark, docs, "")
    want = plain_kept(rows)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == want
    assert 20 < len(rows) - len(want) < 60


def test_near_copies_of_the_tables(spark):
    docs = exact_dedup.drop_copies(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_kept(rows)
    assert len(want) == len(rows) - 5
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == want


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text + " x"), (3, text), (3, text), (3, "other words"), (None, "alone"), (None, "alone too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, simhash.drop_similar(docs).collect()))) == sorted(map(str, [(3, text), (3, "other words"), (None, "alone"), (None, "alone too")]))
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_wide_and_large_shards(spark, monkeypatch):
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i:])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "LARGE_SHARD", 10)
    assert [r.doc_id for r in simhash.drop_similar(docs).collect()] == plain_kept(rows) == [0]


def test_components_larger_than_a_part(spark, monkeypatch):
    """Parts of few texts: links to the first text, within parts, and across them by chains."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(base[:i] + [f"n{i}"] + base[i:])) for i in range(40)]
    chain = list(base)  # each text is near the one before, the last are far from the first
    for i in range(60):
        chain[rng.randrange(300)] = f"c{i}"
        rows.append((100 + i, " ".join(chain)))
    far = [f"f{k}" if k % 3 == 0 else w for k, w in enumerate(base)]
    rows += [(500 + i, " ".join([*far[: i * 7], f"g{i}", *far[i * 7 :]])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "PART", 8)
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == plain_kept(rows)
    monkeypatch.setattr(simhash, "LARGE_SHARD", 2)  # every shard's nodes are candidates
    assert sorted(r.doc_id for r in simhash.drop_similar(docs).collect()) == plain_kept(rows)


def test_roots_with_asking_sets():
    rng = random.Random(9)
    for _ in range(30):
        sets = [simhash.shingles(" ".join(str(rng.randrange(12)) for _ in range(rng.choice([5, 8, 40]))).encode()) for _ in range(15)]
        sets += sets[:4]
        plain = simhash.similar_roots(sets)
        assert (simhash.similar_roots(sets, asks=np.ones(len(sets), bool)) == plain).all()
        assert (simhash.similar_roots(sets, root=plain, asks=np.ones(len(sets), bool)) == plain).all()
