"""SimHash near-duplicates: BK-trees over banded shards, then connected components.

``near_groups`` links fingerprints (op10_simhash_bk). ``drop_similar``, a stage of the pipeline,
uses fingerprints for candidates only and links texts by their exact shingle similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, few, fresh, lookup, materialise

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: A fingerprint is cut into BLOCKS blocks. RADIUS differing bits leave BLOCKS - RADIUS of them
#: untouched, so every link shows up in a shard keyed by some BLOCKS - RADIUS equal blocks.
BLOCKS = 4
#: A shard of more fingerprints is parted again.
HOT_SHARD = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15
#: Texts are similar from SIMILAR on: the Jaccard similarity of their sets of SIMILAR_WORDS-word
#: shingles. Two such texts differ by 10 of 64 bits on average, so candidates may by WIDE_RADIUS.
SIMILAR_WORDS = 5
SIMILAR = 0.8
WIDE_RADIUS = 26
#: Besides the shards of equal blocks there are those of BANDS bands of BAND_HASHES least hashes:
#: 1 - (1 - 0.8^5)^20, or 0.9996, of the pairs of similarity SIMILAR share one, and more of those above.
BANDS = 20
BAND_HASHES = 5
#: A shard of more fingerprints is linked as a whole: the exact check parts it again.
LARGE_SHARD = 1 << 13
#: About so many texts of a component of candidates, and bytes of them, are compared in one task.
PART, PART_BYTES = 512, 16 << 20


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of a UTF-8 text over its word shingles, repeats included; no words: 0."""
    words = (text or b"").lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    last = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, last, CHUNK):
        stop = min(at + CHUNK, last)
        spans = zip(ends[at:stop], ends[min(at + size, len(words)) :], strict=False)
        raw = np.frombuffer(b"".join([digest(joined[a : b - 1], seed) for a, b in spans]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id long, fp long`` (the fingerprint's bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), size, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A Burkhard-Keller tree of 64-bit fingerprints under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def near(self, fp: int, radius: int) -> Iterator[int]:
        """The fingerprints within ``radius``; only edges that can lead to one are followed."""
        stack = [self.root] if self.root else []
        while stack:
            at, children = stack.pop()
            d = (fp ^ at).bit_count()
            if d <= radius:
                yield at
            stack.extend(child for k, child in children.items() if abs(k - d) <= radius)

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        at, children = self.root
        while d := (fp ^ at).bit_count():
            if d not in children:
                children[d] = (fp, {})
                return
            at, children = children[d]


def shard_forest(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, smaller one) that connect what lies within ``radius`` in one shard.

    Only a spanning forest leaves the shard, so a group of n near copies gives n - 1 edges.
    """
    tree, parent = BKTree(), {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for fp in fps:
        parent[fp] = fp
        for other in tree.near(fp, radius):
            a, b = root(fp), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(fp)
    return [(x, r) for x in parent if (r := root(x)) != x]


def _key(*parts: Column) -> Column:
    """The shard of equal parts; two shards of one key only meet in vain."""
    return F.xxhash64(*parts)


def _sharded(rest: Column, blocks: int, width: int, radius: int, *names: Column) -> Column:
    """Arrays of ``(shard, rest)``: for each way to keep ``blocks - radius`` of the blocks of
    ``rest`` (each of ``width`` bits), the shard of what is kept and the bits left over."""
    mask = F.lit((1 << width) - 1)
    parts = [F.shiftrightunsigned(rest, width * i).bitwiseAND(mask) for i in range(blocks)]
    out = []
    for t, kept in enumerate(combinations(range(blocks), blocks - radius)):
        left = F.lit(0).cast("long")
        for i in range(blocks):
            if i not in kept:
                left = F.shiftleft(left, width).bitwiseOR(parts[i])
        out.append(F.struct(_key(*names, F.lit(t), *[parts[i] for i in kept]).alias("shard"), left.alias("rest")))
    return F.array(*out)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT_SHARD) -> DataFrame:
    """``u long, v long`` (u > v): edges that connect all fingerprints within ``radius``.

    ``distinct`` has the distinct fingerprints (``fp long``). Each goes to every shard that
    shares ``blocks - radius`` of its blocks, so a shard's tree holds about n / 2^32 of n
    fingerprints besides its true near-duplicates; the trees meet their queries by shuffle.
    A shard of more than ``hot`` fingerprints is parted again, by blocks of the bits that it
    does not share: two of its fingerprints within ``radius`` agree in as many blocks of these,
    and what is left, 16 bits for radius 2 and 4 blocks, bounds the parts.
    """
    left = 64 // blocks * radius
    shards = distinct.select(F.explode(_sharded(F.col("fp"), blocks, 64 // blocks, radius)).alias("s"), "fp").select("s.shard", "s.rest", "fp")
    sizes = shards.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    sizes = materialise(sizes, "hot")
    if left % blocks == 0 and sizes.limit(1).count():
        large = shards.join(sizes.hint("merge").select("shard"), "shard", "left_semi")
        again = large.select(F.explode(_sharded(F.col("rest"), blocks, left // blocks, radius, F.col("shard"))).alias("s"), "fp").select("s.shard", "fp")
        shards = shards.join(sizes.hint("merge").select("shard"), "shard", "left_anti").select("shard", "fp").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _met(batches):
            if edges := shard_forest(group.view(np.uint64).tolist(), radius):
                pairs = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["u", "v"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("shard", "fp").repartition(n, "shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "u long, v long").distinct()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The second column of each run of two or more rows that agree in the first, sorted one."""
    held: list[np.ndarray] = []
    last = 0
    for b in batches:
        key, value = b.column(0).to_numpy(), b.column(1).to_numpy()
        if held and len(key):
            lead = int(np.searchsorted(key, last, side="right"))
            held.append(value[:lead])
            if lead == len(key):
                continue
            if sum(map(len, held)) > 1:
                yield np.concatenate(held)
            key, value = key[lead:], value[lead:]
        if len(key):
            last = key[-1]
            done = int(np.searchsorted(key, last))  # the last run may go on
            for start, stop in _shared(key[:done]):
                yield value[start:stop]
            held = [value[done:]]
    if sum(map(len, held)) > 1:
        yield np.concatenate(held)


def components(edges: DataFrame) -> DataFrame:
    """``node long, root long`` (the smallest node reachable) of each node that has an edge.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    edges stay the same; the number of rounds grows with the logarithm of the diameter.
    """
    edges = materialise(edges.select("u", "v"), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "large")
        large = materialise(lookup(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "small")
        small = lookup(large, least, "u", "n").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``fingerprint``: 16 lowercase hex digits; ``component_id``: the smallest doc_id reachable
    over links of at most ``radius`` bits. Equal fingerprints are one node, so copies cost
    nothing; empty and null texts have fingerprint zero and link as any other. Null doc_ids
    never name a component unless it has no other. Rows that repeat give a row each; extra
    columns are ignored; long texts are read whole. An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = materialise(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    firsts = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("m")), "firsts")
    named = materialise(lookup(rooted, firsts, "root", "m").select("fp", "n", "component_id"), "named")
    return lookup(fps, named, "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The row of each component that has its smallest doc_id, with all columns of ``docs``.

    Rows that repeat that doc_id are reduced to one.
    """
    kept = materialise(near_groups(docs, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")), "kept")
    stay = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")
    if kept.groupBy("_keep").count().filter("count > 1").limit(1).count():
        stay = stay.dropDuplicates(["doc_id"])
    return stay


def shingles(text: bytes | None, size: int = SIMILAR_WORDS, seed: int = SEED) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    spans = zip(ends[: max(1, len(words) - size + 1)], ends[min(size, len(words)) :], strict=False)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], seed) for a, b in spans], np.uint64))


def set_key(own: np.ndarray) -> int:
    """Names a set of shingles; 0 is the empty one."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) or 1 if len(own) else 0


def set_fingerprint(own: np.ndarray) -> int:
    """SimHash over distinct shingles, each counted once."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(own)).tobytes(), "big")


_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * BAND_HASHES, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, BANDS * BAND_HASHES, np.uint64)[:, None]


def band_keys(own: np.ndarray) -> list[int]:
    """The shards in which a set of shingles meets those similar to it; the empty set has none."""
    if not len(own):
        return []
    least = np.full(BANDS * BAND_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        least = np.minimum(least, (own[None, at : at + 512] * _FACTORS + _SHIFTS).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND_HASHES))]


def block_keys(fp: int) -> list[int]:
    """The shards of a fingerprint by its blocks, as those of ``links``: fingerprints within RADIUS share one."""
    width = 64 // BLOCKS
    parts = [(fp >> width * i & (1 << width) - 1).to_bytes(8, "big") for i in range(BLOCKS)]
    return [xxhash.xxh64_intdigest(b"".join([b"block", *(parts[i] for i in kept)]), k) for k, kept in enumerate(combinations(range(BLOCKS), BLOCKS - RADIUS))]


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, size, node, fp, shards`` of every row.

    ``digest`` and ``size``: hash and bytes of the text; ``node``, ``fp`` and ``shards``: name, fingerprint, and block
    and band keys of its set of shingles. Rows of equal sets share a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            nodes_fps = [[f(own) for own in sets] for f in (set_key, set_fingerprint)]
            nodes, fps = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in nodes_fps)
            keys = [np.array(block_keys(fp) + band_keys(own), np.uint64).view(np.int64) for fp, own in zip(nodes_fps[1], sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), nodes, fps, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "size", "node", "fp", "shards"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text").cast("binary").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return texts.mapInArrow(run, "doc_id long, digest long, size long, node long, fp long, shards array<long>")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The slices of each run of rows that agree in the first column, one run after another."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
        for start, stop in zip(edges, edges[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != key[start]:
                yield held
                held = []
            held.append(b.slice(start, stop - start))
    if held:
        yield held


def wide_forest(nodes: np.ndarray, fps: np.ndarray, radius: int = WIDE_RADIUS) -> np.ndarray:
    """The node that stands for each one's tree, where links are ``radius`` bits long at most.

    Each fingerprint searches the BK-tree of those before it. The search ends once all so far hang
    together, as near copies do from the first hit on: what else it finds would link nothing.
    """
    tree, first, root, apart = BKTree(), {}, list(range(len(nodes))), 0

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, fp in enumerate(fps.tolist()):
        apart += 1
        for other in tree.near(fp, radius):
            a, b = top(i), top(first[other])
            if a != b:
                root[max(a, b)] = min(a, b)
                apart -= 1
            if apart == 1:
                break
        if fp not in first:
            first[fp] = i
            tree.add(fp)
    return nodes[[top(i) for i in range(len(nodes))]]


def wide_links(distinct: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """``u long, v long``: edges that connect the candidates of every shard.

    ``distinct`` has ``node, fp, shards``, one row a node. Shards are dealt by shuffle. In those
    of more than LARGE_SHARD nodes each is a candidate of the first, without a task of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, held = [], [], 0

        def edges() -> pa.RecordBatch:
            pairs = np.array([np.concatenate(us), np.concatenate(vs)])
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=0)), pa.array(pairs.min(axis=0))], ["u", "v"])

        rest = None
        for b in batches:
            table = pa.Table.from_batches([rest, b]) if rest is not None else pa.Table.from_batches([b])
            key, node, fp = (table.column(k).to_numpy() for k in range(3))
            done = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last shard may go on
            rest = table.slice(done).combine_chunks().to_batches()[0] if len(key) else rest
            for start, stop in _shared(key[:done]):
                u = node[start:stop]
                v = wide_forest(u, fp[start:stop].view(np.uint64), radius)
                us.append(u[u != v])
                vs.append(v[u != v])
                held += len(us[-1])
            if held > CHUNK:
                yield edges()
                held = 0
        if rest is not None and rest.num_rows > 1:
            u = rest.column(1).to_numpy()
            v = wide_forest(u, rest.column(2).to_numpy().view(np.uint64), radius)
            us.append(u[u != v])
            vs.append(v[u != v])
        if us:
            yield edges()

    shards = distinct.select(F.explode("shards").alias("shard"), "node", "fp")
    large = materialise(shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("node").alias("v")).filter(F.col("n") > LARGE_SHARD), "large_shards")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = lambda some: some.repartition(n, "shard").sortWithinPartitions("shard", "node").mapInArrow(run, "u long, v long")
    if not large.limit(1).count():
        return within(shards).distinct()
    to_first = lookup(shards, large, "shard", "n").filter("node != v").select(F.col("node").alias("u"), "v")
    return within(shards.join(large.select("shard"), "shard", "left_anti")).unionByName(to_first).distinct()


def _shared(key: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the runs of two or more equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    stops = np.r_[starts[1:], len(key)]
    some = stops - starts > 1
    return list(zip(starts[some].tolist(), stops[some].tolist(), strict=True))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def similar_roots(sets: list[np.ndarray], least: float = SIMILAR, root: np.ndarray | None = None, asks: np.ndarray | None = None) -> np.ndarray:
    """The index that stands for each set's component over links of similarity ``least``.

    All pairs are linked but those whose sizes rule it out or that are connected already, in
    ``root`` from the start; with ``asks`` only pairs that hold a set so marked.
    """
    size = np.array([len(x) for x in sets], np.int64)
    root = np.arange(len(sets)) if root is None else root.copy()
    for i in range(1, len(sets)) if asks is None else np.flatnonzero(asks):
        others = slice(i) if asks is None else slice(None)
        low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        left = np.flatnonzero((low >= least * high - 1e-6) & (root[others] != root[i]))
        while len(left):
            j, left = left[0], left[1:]
            if similarity(sets[i], sets[j]) >= least:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root[root == b] = a
                left = left[root[left] != root[i]]
    return root


def similar_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``node, root`` of the nodes that are similar to another: candidates checked exactly.

    ``members``: ``loose, node, doc_id, digest, size``, the row of ``docs`` that stands for a node and
    the candidates' component it lies in. A task holds the shingles of about PART nodes or PART_BYTES: larger
    components are dealt to parts, each of which compares its nodes with each other and with
    the component's first node. What that leaves unlinked to the first node is compared with
    all other nodes of the component, a part of the one with a part of the others at a time,
    so no pair of texts is left out; nodes linked to the first need no comparison of their own.
    """
    sizes = materialise(members.groupBy("loose").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"), F.min("node").alias("centre")), "sizes")
    sized = lookup(members, sizes, "loose", "m").withColumn("parts", _parts("m", "bytes")).drop("bytes")
    dealt = materialise(sized.withColumn("part", _part("node", "parts")), "dealt")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    units = dealt.withColumn("part", F.explode(F.when(F.col("node") == F.col("centre"), every).otherwise(F.array("part"))))
    found = materialise(_linked(docs, units.select(F.xxhash64("loose", "part").alias("unit"), "node", F.col("node").alias("root"), F.lit(False).alias("asks"), "doc_id", "digest")).distinct(), "found")
    large = dealt.filter("parts > 1").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = (F.col("root") != F.col("centre")).cast("long")
    counted = materialise(large.groupBy("loose").agg(F.count("*").alias("m"), F.sum(apart).alias("apart"), F.sum(apart * F.col("size")).alias("bytes")).filter("apart > 0"), "counted")
    if not counted.limit(1).count():
        return found
    large = materialise(lookup(large.drop("m"), counted, "loose", "m").withColumn("others", _parts("apart", "bytes")), "large")
    against = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    asking = large.filter("root != centre").withColumn("other", _part("root", "others")).withColumn("part", F.explode(every)).withColumn("asks", F.lit(True))
    asked = large.withColumn("other", F.explode(against)).withColumn("asks", F.lit(False))
    units = asking.unionByName(asked).groupBy("loose", "other", "part", "node", "root", "doc_id", "digest").agg(F.max("asks").alias("asks"))
    merged = _linked(docs, units.select(F.xxhash64("loose", "other", "part").alias("unit"), "node", "root", "asks", "doc_id", "digest"))
    # a part names the roots it joins; nodes of one part's roots are joined across parts
    joined = components(merged.filter("node != root").select(F.greatest("node", "root").alias("u"), F.least("node", "root").alias("v")).distinct())
    top = materialise(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "top")
    moved = found.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(top.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct()


def _parts(nodes: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(nodes) / PART), F.ceil(F.col(size) / PART_BYTES))


def _part(key: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(SEED)), F.col(parts))


def _linked(docs: DataFrame, units: DataFrame) -> DataFrame:
    """``node, root``: the links that each unit's texts show, as (root so far, root found).

    ``units``: ``unit, node, root, asks, doc_id, digest``. Where rows of a unit ask, only pairs
    with such a row are compared; else all are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches):
            sets: dict[int, np.ndarray] = {}
            roots, asks = [], []
            for b in group:
                for node, root, ask, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                    if node not in sets:  # a row that repeats another
                        sets[node] = shingles(text.as_py())
                        roots.append(root)
                        asks.append(ask)
            names, known = np.unique(np.array(roots, np.int64), return_inverse=True)
            now = similar_roots(list(sets.values()), root=known, asks=np.array(asks) if any(asks) else None)
            pairs = np.unique(np.array([names[known], names[now]]), axis=1)
            own = pairs[0] != pairs[1]
            if own.any():
                linked = own | np.isin(pairs[0], pairs[1][own])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0][linked]), pa.array(pairs[1][linked])], ["node", "root"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_digest"), F.col("text").cast("binary").alias("text"))
    units = few(materialise(units, "units"))
    met = texts.join(units, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.select("unit", "node", "root", "asks", "text").repartition(n, "unit").sortWithinPartitions("unit", "node").mapInArrow(run, "node long, root long")


def drop_similar(docs: DataFrame) -> DataFrame:
    """One row of each component over texts of similarity SIMILAR or more, all columns kept.

    The row with the smallest doc_id stays (null ids last); of rows that repeat its id and text
    one does. Texts are similar by the Jaccard similarity of their sets of five-word shingles
    (see ``shingles``), computed exactly for all pairs among candidates; texts without words
    equal each other. Candidates meet in the BK-tree of a shard, where they differ by WIDE_RADIUS bits at
    most; shards are those of equal fingerprint blocks, as of op10, and bands of least hashes, as
    similar texts may differ in every two blocks.
    """
    rows = materialise(sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    distinct = materialise(rows.groupBy("node").agg(first, F.first("fp").alias("fp"), F.max("size").alias("size"), F.first("shards").alias("shards")), "distinct")
    loose = components(wide_links(distinct)).select("node", F.col("root").alias("loose"))
    members = materialise(distinct.join(loose, "node").select("loose", "node", "first.doc_id", "first.digest", "size"), "members")
    roots = materialise(similar_links(docs, members), "similar")
    rooted = materialise(distinct.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    # what goes is looked up, not what stays: it is far less
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    own = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    flagged = materialise(own.join(kept, own["doc_id"].eqNullSafe(kept["_id"]) & (own["digest"] == kept["_digest"]), "left").select("doc_id", "digest", "n", F.col("_digest").isNull().alias("goes")), "flagged")
    i, digest = fresh(docs, "i", "digest")
    gone = few(materialise(flagged.filter("goes").select(F.col("doc_id").alias(i), F.col("digest").alias(digest)), "gone"))
    stay = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(digest)), "left_anti")
    if flagged.filter("n > 1 AND NOT goes").limit(1).count():
        stay = stay.dropDuplicates(["doc_id", "text"])
    return stay


def op10_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(dealt_table(spark, sf_dir, "documents"))
