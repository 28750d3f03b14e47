"""The mixing stage of the pipeline: whole documents reach their source's target, long ones too."""

from collections import defaultdict

import pytest

import corpus_pipeline
from scanframe.llm import mixing

LONG = 1280


@pytest.mark.parametrize("hot", [False, True])
def test_sources_and_long_documents_reach_their_targets(spark, hot):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    if hot:  # a source of weight 1 with a third of the rows has a target below half its size
        docs = docs.selectExpr("doc_id", "text", "lang", "CASE WHEN doc_id % 10 < 3 THEN 'c' WHEN doc_id % 10 = 3 THEN 'b' WHEN doc_id % 10 < 7 THEN 'a' ELSE 'd' END AS source", "n_chars")
    source = {r.doc_id: r.source for r in docs.collect()}
    mixed = {r.doc_id: r for r in mixing.mix(docs).collect()}
    copies = defaultdict(int)
    for r in corpus_pipeline.mix(spark, docs, "").collect():
        copies[r.doc_id] += 1
    words, target, longest = defaultdict(int), {}, defaultdict(int)
    long_words, long_taken = defaultdict(int), defaultdict(int)
    for i, r in mixed.items():
        s = source[i]
        assert copies[i] in ({r.taken // r.size, -(-r.taken // r.size)} if r.size else {1})
        words[s] += copies[i] * r.size
        target[s], longest[s] = r.target, max(longest[s], r.size)
        if r.size >= LONG:
            long_words[s] += copies[i] * r.size
            long_taken[s] += r.taken
    for s in target:
        assert abs(words[s] - target[s]) <= 1.5 * longest[s] + 2 * mixing.BLOCK_WORDS, s
        assert abs(long_words[s] - long_taken[s]) <= 1.5 * longest[s], s
    if hot:
        assert target["c"] < 0.5 * next(r.source_size for i, r in mixed.items() if source[i] == "c")
        assert long_words["c"] > 0


def test_copies_follow_the_fraction(spark):
    rows = [(k % 2, k, 1000 + k, (300 if k % 2 else 1300) + k) for k in range(400)]
    taken = spark.createDataFrame(rows, "rank int, doc_id long, size long, taken long")
    got = [mixing.whole_copies(taken.repartition(n)).collect() for n in (1, 5)]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))
    for rank in (0, 1):
        own = [r for r in got[0] if r["rank"] == rank]
        assert abs(sum(r.copies for r in own) - sum(r.taken / r["size"] for r in own)) <= 1
        assert {r.copies for r in own} == ({0, 1} if rank else {1, 2})
