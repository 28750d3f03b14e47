"""Extra columns by any name pass through the pipeline's stages and change no operator's result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scanframe.llm import ann, exact_dedup, extraction, langid, mixing, packing, pii, simhash, substrings, tokens, urls, whitening
from scanframe.llm.common import table

SF = "/root/testdata/sf0.001"
NAMES = (
    "_digest", "_id", "_copy", "_copies", "_keep", "_row", "rank", "digest", "unit", "node", "own", "i", "i_", "copies", "Copy", "size", "taken", "fp", "shards", "shard", "root", "n", "k", "key", "kept", "keep_id", "group_size",
    "lang_pred", "score", "held_out", "chars", "spans", "piece", "start", "length", "sequence_id", "offset", "n_tokens", "n_bytes", "x", "d", "component", "query_id", "verdict", "rule", "host", "path", "content", "component_id", "fingerprint", "target", "source_size", "weight",
)


def _odd(df, sf=SF):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(k).cast("string").alias(n) for k, n in enumerate(NAMES) if n.lower() not in taken])


def _sorted(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages(spark, name, stage):
    docs = table(spark, SF, "documents")
    odd = stage(spark, _odd(docs), SF)
    assert odd.columns == _odd(docs).columns
    given, got = {repr(r): r for r in _odd(docs).collect()}, odd.collect()
    assert all(repr(r) in given for r in got) and len(got) > 100


OPERATORS = {
    "pii": (pii.find, "documents"), "urls": (urls.url_verdicts, "pages"), "mixing": (mixing.mix, "documents"), "exact": (exact_dedup.exact_groups, "documents"), "tokens": (tokens.token_counts, "documents"),
    "packing": (lambda d: packing.best_fit(d).drop("sequence_id", "offset"), "documents"), "simhash": (simhash.near_groups, "documents"), "html": (extraction.extract, "pages"), "whitening": (lambda d: whitening.whiten(d).drop("whitened", "identity_error", "explained"), "embeddings"),
    "language": (langid.identify, "documents"), "substrings": (substrings.drop_repeats, "documents"), "neighbours": (ann.search, "embeddings"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, name):
    run, source = OPERATORS[name]
    rows = table(spark, SF, source)
    assert _sorted(run(_odd(rows))) == _sorted(run(rows))

