"""Personal data: the fixed spans against Python's re, and the weak supervision."""

import hashlib
import random
import re

import pytest

from scanframe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    spans = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                spans.append((kind, *m.span()))
    counts = tuple(sum(s[0] == k for s in spans) for k in PATTERNS)
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()), spans


def texts():
    rng = random.Random(5)
    alphabet = ["@", ".", "-", "+", " ", "(", ")", "1", "2", "25", "4", "0", "a", "b", "é", "😀", "com", "4111 1111 1111 1111", "+1 (017) 555-7713", "8.8.8.8", "x@y.zz", "\n", "_", "%"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    return [
        None, "", " ", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1", "+12", "+12+345678901", "4" * 100_000, "a" * 100_000, "a@" * 3000, "x@y" + ".z" * 20_000,
        "1." * 20_000, "+1 " * 5000, " ".join(f"u{k}@mail.example.com" for k in range(3000)), "😀" * 50 + "me@x.org 4111-1111-1111-1111", *made,
    ]


def test_fixed_spans(spark):
    cases = texts()
    df = spark.createDataFrame([(k, t, 1, "s") for k, t in enumerate(cases)], "doc_id long, text string, spans int, fixed string").repartition(8)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(got) == len(cases)
    for k, t in enumerate(cases):
        want, spans = plain(t or "")
        assert tuple(got[k])[1:6] == want, (t or "")[:80]
        found = [tuple(s.split(":")) for s in got[k].spans.split(",") if s]
        assert {(a, str(b), str(c)) for a, b, c in spans} <= set(found)
        assert found == sorted(found, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
    assert pii.find(df.limit(0)).count() == 0


def test_method_adds_spans(spark):
    rows = [(k, f"please call me: (212) 555-01{k:02d} or write to jo{k} (at) mail{k} (dot) com today") for k in range(60)]
    rows += [(100 + k, f'login token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end') for k in range(60)]
    rows += [(200 + k, f"order {20000000 + k * 37} version") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].count("phone:") == 1 and got[k].count("email:") == 1 for k in range(60))
    assert all("secret:6:" in got[100 + k] for k in range(60))
    assert not any(got[200 + k] for k in range(60))


def test_em_recovers_reliabilities():
    rng = random.Random(1)
    counts = {}
    for _ in range(40_000):
        truth = rng.random() < 0.3
        say = lambda p, silent: 0 if rng.random() < silent else (1 if (rng.random() < p) == truth else -1)  # noqa: E731, B023
        v = (say(0.95, 0.05), say(0.8, 0.2), say(0.7, 0.4))
        counts[v] = counts.get(v, 0) + 1
    prior, given, sure = pii.reliabilities(counts)
    assert prior == pytest.approx(0.3, abs=0.03)
    assert given[0][1, 1] == pytest.approx(0.95 * 0.95, abs=0.04)
    assert given[1][1, 1] == pytest.approx(0.8 * 0.8, abs=0.04)
    assert sure[1, 1, 1] > 0.97 and sure[-1, -1, -1] < 0.03


def test_many_matches_and_repeated_rows(spark):
    text = "".join(f"a{k}@x.com {10_000_000 + k} " for k in range(50_000))
    rows = [(1, text, "e"), (2, "x@y.zz 8.8.8.8", "e"), (2, "x@y.zz 8.8.8.8", "e"), (None, "x@y.zz", "e"), (None, "x@y.zz", "e")]
    got = sorted(pii.find(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect(), key=str)
    want = sorted([(i, *plain(t)[0]) for i, t, _ in rows], key=str)
    assert [tuple(r)[:6] for r in got] == want and got[0].n_email in (1, 50_000)


def test_no_added_span_overlaps_a_fixed_one(spark):
    rng = random.Random(9)
    bits = ["a@b.cc", "token=\"abcdefgh\"", "8.8.8.8", "12345678", "(at)", " ", "x", "+4912345678", "4111 1111 1111 1111", "212 555 0100", "u (at) v.com"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randint(1, 30)))) for k in range(400)]
    for r in pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        fixed = [s for s in r.spans if s.base]
        plain_rest = [s for s in r.spans if not s.base]
        assert not any(f.start < s.end and s.start < f.end for s in plain_rest for f in fixed)
        assert all(rows[r.doc_id][1][s.start : s.end] == s.text for s in r.spans)
