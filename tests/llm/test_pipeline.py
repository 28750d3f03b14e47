"""Each stage of the pipeline against a plain version of its own, and the stages' contracts."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_langid import plain_predict
from test_text_ops import plain_targets

import corpus_pipeline
from scanframe.llm import langid, tokens

SF = "/root/testdata/sf0.001"


def plain_language(docs, rows):
    texts = langid.fit(docs).texts
    return {i for i, r in rows.items() if (found := plain_predict(texts, r.text))[0] != "und" and found[2] >= langid.LEAST_PHRASE}


def plain_exact(docs, rows):
    groups = defaultdict(list)
    for i, r in rows.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), i))
    return {min(g)[1] for g in groups.values()}


def plain_near(docs, rows):
    """All pairs of sets of five-word shingles, linked from a similarity of 0.8 on."""
    sets = {}
    for i, r in rows.items():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                    root[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in ids if top(i) == i}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after every stage, each written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        assert k == 4 or after.columns == columns
        out[name] = (docs, after)
        docs = after
    return out


@pytest.mark.parametrize(("name", "plain"), [("language_id", plain_language), ("exact_dedup", plain_exact), ("simhash_near_dedup", plain_near)])
def test_filtering_stages(stages, name, plain):
    before, after = stages[name]
    rows = {r.doc_id: r for r in before.collect()}
    got = after.collect()
    assert {r.doc_id for r in got} == plain(before, rows) and len({r.doc_id for r in got}) == len(got)
    assert all(r == rows[r.doc_id] for r in got)


def test_mixing_stage(stages):
    before, after = stages["mix_sources"]
    rows, size = {r.doc_id: r for r in before.collect()}, defaultdict(int)
    words = lambda r: len((r.text or "").encode().split())
    longest = defaultdict(int)
    for r in rows.values():
        size[r.source] += words(r)
        longest[r.source] = max(longest[r.source], words(r))
    got, copies = defaultdict(int), defaultdict(int)
    for r in after.collect():
        assert r == rows[r.doc_id]
        got[r.source] += words(r)
        copies[r.doc_id] += 1
    assert max(copies.values()) <= 2 and all(copies[i] == 1 for i, r in rows.items() if not words(r))
    for s, want in plain_targets(size).items():
        assert abs(got[s] - want) <= 1.5 * longest[s] + 256


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    before, after = stages["best_fit_packing"]
    want = []
    for r in before.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = after.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_run_is_the_stages_one_after_another(spark, stages):
    whole = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, stages["best_fit_packing"][1].drop("sequence_id", "offset").collect()))


def test_empty_and_extra_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 size", "'x' fp", "2 _row", "array(1) spans")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.limit(0), "").columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0
        assert stage(spark, docs, "").columns == docs.columns
