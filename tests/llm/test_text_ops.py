"""Exact dedup, SimHash, packing, token counts, mixing and url rules against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from scanframe.llm import common, exact_dedup, mixing, packing, simhash, tokens, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, digest string, row int"
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one "), (6, "two words"), (7, "Two Words"), (8, "o ne"),
    (9, "a b c d e " * 40), (10, "a b c d e " * 40), (11, "x" * 70_000), (12, "é ü <|endoftext|> \x85 \xa0 \u2003 z"), (None, "one"), (13, "word " * 30_000),
    (14, "one"), (14, "one"),
]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s if (s := ["b", "a", None][k % 3]) else None, None, "f", 1, "d", 2) for k, (i, t) in enumerate(rows)], DOCS)


def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup.exact_groups(docs(spark, ODD)).collect()
    groups = defaultdict(list)
    for i, t in ODD:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    want = []
    for i, t in ODD:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n])[2]
        want.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_dedup_appends_only_new(spark):
    index = exact_dedup.DigestIndex(spark, "index_of_two_batches", buckets=4)
    exact_dedup.exact_groups(docs(spark, [(1, "a"), (2, "b")]), index)
    second = exact_dedup.exact_groups(docs(spark, [(3, "a "), (4, "c")]), exact_dedup.DigestIndex(spark, "index_of_two_batches"))
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in second.collect()) == [(3, 1, False), (4, 4, True)]
    assert index.entries().count() == 3
    left = exact_dedup.drop_copies(docs(spark, ODD))
    assert len(left.columns) == 9 and left.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD})


def plain_fingerprint(text):
    words = re.findall(common.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(fps):
        least[root(k)].append(i)
    return sorted(((i, f"{f:016x}", min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, f) in enumerate(fps)), key=str)


@pytest.mark.parametrize("which", ["odd", "sample", "near"])
def test_simhash(spark, which):
    if which == "near":
        base = [f"w{k}" for k in range(300)]
        rows = [(i, " ".join(base[: 150 + i] + [f"n{i}"] + base[150 + i :])) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(5)]
    else:
        rows = ODD if which == "odd" else [(r.doc_id, r.text) for r in sample(spark).collect()]
    got = simhash.near_groups(docs(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_components(rows)


def test_simhash_empty_and_drop(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0
    left = simhash.drop_near_copies(docs(spark, ODD))
    assert len(left.columns) == 9
    assert {r.doc_id for r in left.collect()} == {i for i, _, c in plain_components(ODD) if i == c}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.lists(st.sets(st.integers(0, 63), max_size=3), max_size=40))
def test_bk_tree_finds_all(bases, flips):
    fps = sorted({b ^ sum(1 << f for f in s) for b in bases for s in flips} | set(bases))
    tree = simhash.BKTree()
    for f in fps:
        tree.add(f)
    for f in fps:
        assert sorted(tree.near(f, 2)) == [g for g in fps if (f ^ g).bit_count() <= 2]


@pytest.mark.parametrize("hot", [2, 50, 10**6])
def test_links_of_hot_shards(spark, hot):
    import random

    rng = random.Random(3)
    bases = [rng.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}) for b in bases for _ in range(150)} | {0, 1, 2**64 - 1})
    rows = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(rows, "fp long"), hot=hot).collect()
    parent = {f[0]: f[0] for f in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 64 and r.u > r.v
        parent[root(r.u)] = root(r.v)
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                assert root(rows[a][0]) == root(rows[b][0])
    plain = {f: f for f in fps}

    def top(x):
        while plain[x] != x:
            x = plain[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                plain[top(fps[a])] = top(fps[b])
    assert len({root(x) for x in parent}) == len({top(x) for x in plain})


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100 + i, 90) for i in range(1, 30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 90 for i in [90, *range(101, 130)]}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))


def test_token_counts(spark, library):
    rows = ODD + [(r.doc_id, r.text) for r in sample(spark).collect()]
    got = sorted((tuple(r) for r in tokens.token_counts(docs(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert tokens.token_counts(docs(spark, [])).count() == 0


ODD_LETTERS = st.text(alphabet=st.sampled_from("abl's1 \n\t.,!<|>é×\u0085\u2003日"), max_size=120)


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD_LETTERS | st.sampled_from(["<|endoftext|>", " <|endoftext|> x", "don't. I'll, we're  so"]), max_size=6))
def test_chunks_keep_the_ids(library, texts):
    model = tokens.loaded(tokens.tokenizer_path(tokens.TOKENIZER))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    chunks = tokens.Chunks(model, pa.array(texts, pa.string()))
    assert [x.tolist() for x in chunks.ids()] == want and chunks.counts().tolist() == list(map(len, want))


def test_chunks_of_every_short_letter(library):
    model = tokens.loaded(tokens.tokenizer_path(tokens.TOKENIZER))
    letters = [chr(c) for c in range(0x250)]
    texts = [a.join(["x", "1", " ", ".", "\n", "s't", ""]) + a + a for a in letters] + [f"{a}{b} {a}" for a in letters[32:127] for b in letters[160:0x250:3]] + ["", "<|endoftext|>x <|endoftext|>"]
    for t, ids in zip(texts, tokens.Chunks(model, pa.array(texts)).ids(), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_whole_documents(spark, library):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    model = tokens.loaded(tokens.tokenizer_path(tokens.TOKENIZER))
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Chunks(model, pa.array(texts)).ids()] == want


def test_tokenizers_without_chunks(spark):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    rows = [(1, "Ab  cd"), (2, ""), (3, None), (4, "it's. so, x\u00e9 y")]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs(spark, rows), path).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_packing(spark, library):
    rows = ODD + [(r.doc_id, r.text) for r in sample(spark).collect()]
    got = packing.best_fit(docs(spark, rows)).collect()
    assert packing.best_fit(docs(spark, [])).count() == 0
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = []
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert len(bins) <= 1.005 * -(-sum(r.length for r in got) // 1024) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_packer_is_bounded_best_fit(lengths, open_bins):
    packer, bins, closed = packing.Packer(50, open_bins), {}, set()
    for n in lengths:
        number, offset = packer.put(n)
        assert number not in closed and bins.get(number, 0) == offset and offset + n <= 50
        fits = [b for b, used in bins.items() if b not in closed and 50 - used >= n]
        assert offset == max((bins[b] for b in fits), default=0)
        bins[number] = offset + n
        if bins[number] == 50:
            closed.add(number)
        elif len(live := [b for b in bins if b not in closed]) > open_bins:
            fullest = max(bins[b] for b in live if b != number)
            closed.add(next(b for b in live if b != number and bins[b] == fullest))


def plain_targets(sizes):
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_weight = sum(w for s, w in weight.items() if s not in fixed)
        left = budget - sum(fixed.values())
        over = [s for s in sizes if s not in fixed and left * weight[s] / open_weight > 2 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / open_weight for s in sizes if s not in fixed}
        fixed |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["odd", "sample", "large"])
def test_mixing(spark, which):
    df = docs(spark, ODD[:-1]) if which == "odd" else spark.read.parquet(f"/root/testdata/{'sf0.001' if which == 'sample' else 'sf0.01'}/documents.parquet")
    rows = df.collect()
    got, again = mixing.mix(df).collect(), mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), len(re.findall(common.WORD, r.text or ""))) for r in rows)
    by_source, size = defaultdict(int), defaultdict(int)
    source = {r.doc_id: r.source for r in rows}
    for r in rows:
        size[r.source] += len(re.findall(common.WORD, r.text or ""))
    want = plain_targets(size)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        by_source[source[r.doc_id]] += r.taken
    for s, n in by_source.items():
        assert abs(n - want[s]) <= 2 * mixing.BLOCK_WORDS


def test_mixing_of_rows_that_repeat(spark):
    rows = [(k % 7, f"w{k % 7} " * 60, "a") for k in range(300)] + [(None, f"x {k} " * 50, "b") for k in range(100)] + [(7, "y " * 90, None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect())) and len(got) == len(rows)
    size = {"a": 300 * 60, "b": 100 * 100, None: 100 * 90}
    want, name = plain_targets(size), {size["a"]: "a", size["b"]: "b", size[None]: None}
    words = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.target == pytest.approx(want[name[r.source_size]])
        words[name[r.source_size]] += r.taken
    assert all(abs(words[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in size)
    mixed = defaultdict(int)
    for r in mixing.resample(df).collect():
        mixed[r.source] += len(r.text.split())
    assert abs(mixed["b"] - want["b"]) <= 2 * 100 + 2 * mixing.BLOCK_WORDS  # texts of one null id are told apart


def test_mixing_empty_and_resample(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None), (2, " ")])).count() == 2
    out = mixing.resample(docs(spark, ODD))
    assert len(out.columns) == 9 and out.count() > 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**60))
def test_permutation(n, key):
    assert sorted(mixing.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_shards_are_multinomial_draws():
    quota = np.array([5000, 2000, 1000])
    draws = np.array([d for _, d in mixing.shard_counts(quota, range(200), 10**9)])
    assert (draws.sum(axis=1) == mixing.SLOTS_PER_SHARD).all()
    assert draws.mean(axis=0) == pytest.approx([640, 256, 128], rel=0.03)
    assert draws.std(axis=0) == pytest.approx([15.5, 13.9, 10.6], rel=0.25)


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://A.Com/en/9?x#y": ("a.com", "/en/9", "com/en/", "block"),
        "http://m.example.com/en/77": ("m.example.com", "/en/77", "example.com/en/7", "allow"), "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "allow"),
        "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "block"), "x://h": ("h", "", None, "allow"), "x://h?a/b": ("h", "", None, "allow"),
        "x://h#a/b://c": ("h", "", None, "allow"), "http://www.spam-farm.org/": ("www.spam-farm.org", "/", None, "block"), "http://spam-farms.org/": ("spam-farms.org", "/", None, "allow"),
        "http://h.org/free-free": ("h.org", "/free-free", None, "allow"), "http://h.org/free/Casino": ("h.org", "/free/Casino", None, "block"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(cases)], "page_id long, url string, html string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.url_verdicts(df.limit(0)).count() == 0
