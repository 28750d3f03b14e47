"""Language ID: the automata against plain search, held-out accuracy, odd rows."""

import binascii
import re

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from scanframe.llm import langid


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abcd ", min_size=1, max_size=12))
def test_automaton_holds_exactly_the_substrings(text, word):
    follow = langid.suffix_automaton(text.encode())
    state = 0
    for c in word.encode():
        state = follow[state].get(c, -1)
        if state < 0:
            break
    assert (state >= 0) == (word in text)


def plain_letters(text):
    words = regex.findall(r"\p{L}+", text or "")
    return f" {' '.join(''.join(low if len(low := c.lower()) == 1 else c for c in w) for w in words)} ".encode() if words else b""


def plain_phrases(sample, text):
    """Greedy parsing by plain search, a phrase ending at every SEGMENT bytes."""
    count = 0
    for start in range(0, len(text), langid.SEGMENT):
        segment, at = text[start : start + langid.SEGMENT], 0
        while at < len(segment):
            end = at + 1
            while end < len(segment) and segment[at : end + 1] in sample:
                end += 1
            count, at = count + 1, end
    return count


def plain_predict(texts, text):
    own = plain_letters(text)
    if not own or not texts:
        return "und", 0.0, 0.0
    counts = {k: plain_phrases(v, own) for k, v in texts.items()}
    costs = {k: counts[k] * np.log2(max(2, len(v))) for k, v in texts.items()}
    first, *others = sorted(costs, key=lambda k: (costs[k], k))
    score = costs[others[0]] / (costs[others[0]] + costs[first]) if others else 1.0
    return first, score, len(own) / counts[first]


WORDS = st.text(st.sampled_from("abnÉéß1-. \nŒ日"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=3), st.lists(WORDS | st.none(), max_size=6))
def test_against_plain_parsing(samples, texts):
    learned = {f"l{k}": own for k, t in enumerate(samples) if (own := plain_letters(t))}
    got = langid.predict(langid.Model(learned), texts)
    for (lang, score, size), t in zip(got, texts, strict=True):
        want = plain_predict(learned, t)
        assert lang == want[0] and abs(score - want[1]) < 1e-12 and abs(size - want[2]) < 1e-12


def test_whole_documents_against_plain_parsing(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()
    learned = {k: b"".join(plain_letters(r.text)[:-1] for r in rows[::3] if r.lang == k)[:6000] for k in ("de", "en", "fr")}
    texts = [r.text for r in rows[1::3]][:20] + ["bcd" * 3000, "the house " * 900]
    got = langid.predict(langid.Model(learned), texts)
    for found, t in zip(got, texts, strict=True):
        want = plain_predict(learned, t)
        assert found[0] == want[0] and np.allclose(found[1:], want[1:])


def test_ties_go_to_the_first_code():
    assert langid.predict(langid.Model({"b": b" ab ", "a": b" ab "}), ["ab", "x"]) == [("a", 0.5, 4.0), ("a", 0.5, 1.0)]
    assert langid.predict(langid.Model({}), ["ab"]) == [("und", 0.0, 0.0)]


def test_learns_only_from_labelled_rows_that_are_not_held_out(spark):
    out = [k for k in range(400) if binascii.crc32(str(k).encode()) % 4 == 2]
    rows = [(k, "zzz qqq " * 3 if k in out else "red house " * 3, "en") for k in range(400)] + [(1000, "xyxy " * 2000, "la"), (1001, "xyxy " * 3000, "la"), (1002, None, "en"), (1003, "kkkk", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["en", "la"] and model.column[ord("z")] == 0 and model.column[ord("k")] == 0
    assert abs(model.cost[1] - np.log2(10_001)) < 1e-9  # only long rows: the shortest one, whole
    small = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=300)
    assert small.cost[0] <= np.log2(300)


def test_a_megabyte_without_spaces_is_quick():
    import time

    began = time.perf_counter()
    langid.predict(langid.Model({"en": b" the quick brown fox ", "fr": b" le renard "}), ["abcdefghij" * 100_000])
    assert time.perf_counter() - began < 5


def test_predictions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert langid.keep_identified(docs).count() == docs.count()


def test_odd_rows(spark):
    base = [(k, "the cat of the house", "en", "s") for k in range(40)] + [(50 + k, "la maison du chat", "fr", None) for k in range(40)]
    odd = [(100, None, "en", "s"), (101, "", "fr", "s"), (102, "123 ½ ²!", None, "s"), (None, "the house", "en", "s"), (103, "x" * 200_000, None, None), (104, "du chat " * 50_000, None, None), (105, "日本語" * 10, None, None), (105, "日本語" * 10, None, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in base + odd], "doc_id long, text string, lang string, source string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[k].lang_pred == "en" for k in range(40)) and all(got[50 + k].lang_pred == "fr" for k in range(40))
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[None].lang_pred == "en" and not got[None].held_out
    assert got[104].lang_pred == "fr"
    kept = [r.doc_id for r in langid.keep_identified(df).collect()]
    assert not {100, 101, 102, 103, 105} & set(kept) and len(kept) == 82
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert re.fullmatch("[a-z]+", got[104].lang_pred)
