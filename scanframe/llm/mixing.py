"""Mixing sources to target weights: token blocks drawn per output shard.

Each source's words, in document order, are cut into blocks of a fixed number of words. Output
shards draw multinomial source counts; the k-th slot of a source maps to a block through a
pseudorandom permutation of its block numbers, and blocks join by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanframe.llm.common import WORD, dealt_table, fresh, lookup, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 128
SLOTS_PER_SHARD = 1024
SEED = 17
#: Document buckets of a source, over which its running word count is summed in two steps: this
#: many, or one for every BUCKET_DOCS documents of the table where that is more.
BUCKETS = 1024
BUCKET_DOCS = 1 << 16
#: Slots that one task fills, about, and passes on at a time.
SLOTS_PER_TASK = 1 << 16
#: For whole copies the count runs over documents by length: SIZE_CLASSES classes to a doubling,
#: each in SIZE_BUCKETS buckets. Fractions of a copy are counted in units of 1 / COPY.
SIZE_CLASSES = 4
SIZE_BUCKETS = 256
COPY = 1 << 30
_MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def permute(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n): a Feistel network with cycle walking."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64).copy()
    keys = [np.uint64(_mix(key * rounds + r)) for r in range(rounds)]
    walk = np.ones(len(x), bool)
    while walk.any():
        left, right = x[walk] >> np.uint64(half), x[walk] & low
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        x[walk] = (left << np.uint64(half)) | right
        walk = x >= np.uint64(n)
    return x.astype(np.int64)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, source, size`` of every row: a hash of the text tells rows of one id
    apart; null text has no words."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("digest"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, rank, docs, source_size, target``: one row a source.

    Weights repeat over the sources in code-point order, null last. ``share`` of all words is
    split by weight; a source stops at ``most`` times its size and the excess is shared anew
    among the others by weight, until none is above: the level at which the capped targets add
    up is found in one pass over the sources by rising capacity for a unit of weight.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.lit(most) * F.col("source_size")
    ranked = by_source.withColumn("rank", rank).withColumn("w", w).withColumn("cap", cap)
    rising = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    capped = F.col("level") * F.col("w") >= F.col("cap")
    # the level is that of the first source, by rising capacity, that its cap does not stop
    leveled = ranked.withColumn("level", level)
    final = F.min(F.when(~capped, F.struct((F.col("cap") / F.col("w")).alias("c"), F.col("rank").alias("r"), F.col("level").alias("l")))).over(everything)["l"]
    target = F.least(F.col("cap"), F.coalesce(final * F.col("w"), F.col("cap")))
    return leveled.withColumn("target", target).select("source", "rank", "docs", "source_size", "target")


def spans(sized: DataFrame, ranked: DataFrame) -> DataFrame:
    """Add ``rank, source_size, target`` and ``at``, the words of the source before the row.

    ``sized`` must be materialised. Large sources are looked up by broadcast, all others by shuffle.

    The running sum is taken within BUCKETS buckets of a source and over their totals, so no
    task holds a source.
    """
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a source of its own
    placed = lookup(sized.withColumn("key", key), materialise(ranked.withColumn("key", key).drop("source"), "ranked"), "key", "docs").drop("key", "docs")
    buckets = max(BUCKETS, sized.count() // BUCKET_DOCS)
    bucketed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)))
    inner = Window.partitionBy("rank", "bucket").orderBy("doc_id", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("rank", "bucket").agg(F.sum("size").alias("total"))
    outer = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("rank", "bucket", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("base"))
    within = bucketed.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return within.join(starts, ["rank", "bucket"]).withColumn("at", F.col("base") + F.col("within")).drop("bucket", "base", "within")


def quotas(ranked: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``rank, blocks, quota``: block count and slots of each source that has words."""
    blocks = F.ceil(F.col("source_size") / block_words)
    return ranked.filter("source_size > 0").select("rank", blocks.alias("blocks"), F.round(F.col("target") * blocks / F.col("source_size")).cast("long").alias("quota"))


def shard_counts(quota: np.ndarray, shards: range, total: int, slots: int = SLOTS_PER_SHARD, seed: int = SEED) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, slots of each source): a seeded multinomial draw for each shard."""
    p = quota / quota.sum()
    for shard in shards:
        rng = np.random.default_rng([seed, shard])
        yield shard, rng.multinomial(min(slots, total - shard * slots), p)


def slots(spark: SparkSession, ranked: DataFrame, block_words: int = BLOCK_WORDS, per_shard: int = SLOTS_PER_SHARD, seed: int = SEED) -> DataFrame:
    """``shard, rank, slot, block``: every slot of the mix and the block it takes.

    A source's slots are numbered over its shards' draws. Draws past its quota are dropped and
    what it was drawn short is made up in further shards, so each source gets its quota to the
    block, and no block is taken more often than the rounds its quota makes over the source.
    """
    own = materialise(quotas(ranked, block_words).filter("quota > 0"), "quotas")
    listed = own.select("rank", "quota").orderBy("rank").toArrow()
    total = int(sum(listed.column("quota").to_pylist()))
    n_shards = -(-total // per_shard)
    # two numbers a source, whatever their documents: every shard draws from all sources
    sent = spark.sparkContext.broadcast((listed.column("rank").to_numpy(), listed.column("quota").to_numpy()))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, quota = sent.value
        for b in batches:
            for shard in b.column(0).to_pylist():
                _, drawn = next(shard_counts(quota, range(shard, shard + 1), total, per_shard, seed))
                some = np.flatnonzero(drawn)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(ranks[some], pa.int32()), pa.array(drawn[some])], ["shard", "rank", "drawn"])

    if not total:
        return spark.createDataFrame([], "shard long, rank int, slot long, block long")
    tasks = max(1, min(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = materialise(spark.range(0, n_shards, 1, tasks).mapInArrow(draw, "shard long, rank int, drawn long"), "draws")
    # running counts in two steps, over groups of shards, as a source has a row a shard
    group = F.floor(F.col("shard") / 1024)
    inner = Window.partitionBy("rank", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    grouped = drawn.withColumn("group", group)
    bases = grouped.groupBy("rank", "group").agg(F.sum("drawn").alias("sum")).select("rank", "group", F.coalesce(F.sum("sum").over(outer), F.lit(0)).alias("base"))
    first = F.col("base") + F.coalesce(F.sum("drawn").over(inner), F.lit(0))
    counted = grouped.join(bases, ["rank", "group"]).withColumn("first", first).join(own, "rank")
    within = counted.select("shard", "rank", "first", F.least("quota", F.col("first") + F.col("drawn")).alias("stop"), "blocks").filter("first < stop")
    reached = own.join(drawn.groupBy("rank").agg(F.sum("drawn").alias("n")), "rank", "left").withColumn("first", F.coalesce("n", F.lit(0)))
    missing = reached.filter("first < quota").withColumn("start", F.explode(F.sequence("first", F.col("quota") - 1, F.lit(per_shard).cast("long"))))
    made_up = F.lit(n_shards) + ((F.col("start") - F.col("first")) / per_shard).cast("long")
    short = missing.select(made_up.alias("shard"), "rank", F.col("start").alias("first"), F.least("quota", F.col("start") + per_shard).alias("stop"), "blocks")
    # a range is a shard's at most, so equal numbers of ranges are about equal numbers of slots
    ranges = within.unionByName(short).select("shard", "rank", "first", "stop", "blocks").repartition(max(1, -(-total // SLOTS_PER_TASK)))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            shard, rank, slot, block = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(rank, pa.int32()), pa.array(slot), pa.array(block)], ["shard", "rank", "slot", "block"])

        for b in batches:
            for shard, rank, start, stop, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = np.arange(start, stop)
                taken = np.empty(len(k), np.int64)
                for turn in np.unique(k // n):
                    own = k // n == turn
                    taken[own] = permute(k[own] % n, n, _mix(seed) ^ _mix(rank << 20 | int(turn)))
                held.append((np.full(len(k), shard), np.full(len(k), rank), k, taken))
                size += len(k)
                if size >= SLOTS_PER_TASK:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return ranges.mapInArrow(fill, "shard long, rank int, slot long, block long")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    ``taken``: words of the document that the mix takes, repeats counted. A document lies in
    the blocks that its words fall into; a block is taken at most twice, so ``taken`` is at
    most twice ``size``. Documents without words take nothing. Rows that repeat are documents
    of their own. Same input, same mix. An empty table gives no rows. Extra columns are ignored;
    a null source is a source, the last one.
    """
    return _taken(docs, block_words).drop("rank", "digest")


def _taken(docs: DataFrame, block_words: int) -> DataFrame:
    """As ``mix``, with the ``rank`` of the source."""
    spark = docs.sparkSession
    sized = materialise(sizes(docs), "sizes")
    ranked = materialise(targets(sized), "targets")
    placed = materialise(spans(sized, ranked), "spans")
    # merge hints: the size of an Arrow function's output is estimated as that of its input, a
    # few draws, and the planner would broadcast a row a block
    uses = slots(spark, ranked, block_words).groupBy("rank", "block").agg(F.count("*").alias("uses"))
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    parts = placed.filter("size > 0").select("rank", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * block_words)
    stop = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    taken = parts.join(uses.hint("merge"), ["rank", "block"]).groupBy("rank", "at").agg(F.sum((stop - start) * F.col("uses")).alias("taken"))
    empty = placed.filter("size = 0").select("rank", "doc_id", "digest", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    full = placed.filter("size > 0").join(taken.hint("merge"), ["rank", "at"], "left")
    return full.select("rank", "doc_id", "digest", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).unionByName(empty)


def whole_copies(taken: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``copies``, ``taken / size`` as a whole number, to ``rank, doc_id, size, taken`` (and ``digest``).

    It is rounded up as often as the fraction says: fractions are summed within a source from
    a seeded start, by rising size class, and a document gets one more where the sum passes a
    whole number. So a source's words, and those of its short and its long documents, come to
    what the mix takes but for about the longest document. Documents without words stay once.
    """
    some, names = taken.filter("size > 0"), [c for c in ("doc_id", "digest") if c in taken.columns]
    rest = F.floor(F.expr(f"((taken % size) * {COPY}L) div size"))
    size_class = F.floor(F.log2("size") * SIZE_CLASSES)
    dealt = some.withColumn("rest", rest).withColumn("class", size_class).withColumn("bucket", F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(SIZE_BUCKETS)))
    inner = Window.partitionBy("rank", "class", "bucket").orderBy("size", *names, "taken").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("rank").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("rank", "class", "bucket").agg(F.sum("rest").alias("total"))
    start = F.pmod(F.xxhash64("rank", F.lit(seed)), F.lit(COPY))
    bases = totals.select("rank", "class", "bucket", (F.coalesce(F.sum("total").over(outer), F.lit(0)) + start).alias("base"))
    summed = dealt.withColumn("within", F.sum("rest").over(inner)).join(bases, ["rank", "class", "bucket"]).withColumn("stop", F.col("base") + F.col("within"))
    copies = F.expr(f"taken div size + stop div {COPY}L - (stop - rest) div {COPY}L").cast("int")
    return summed.select(*taken.columns, copies.alias("copies")).unionByName(taken.filter("size = 0").withColumn("copies", F.lit(1)))


def resample(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents of the mix: each repeated 0, 1 or 2 times, on average as often as the mix
    takes it (see ``whole_copies``), with all columns. Documents without words stay once.

    Rows are told apart by doc_id and text; of rows that repeat both, and of what they take
    together, each gets its share. Null doc_ids are ids like others. An empty table stays so.
    """
    placed = _taken(docs, block_words).select("rank", "doc_id", "digest", "size", "taken")
    # rows of one id and text, which nothing tells apart, share what they take
    alike = placed.groupBy("rank", "doc_id", "digest", "size").agg(F.avg("taken").alias("mean"))
    shared = materialise(alike.select("rank", "doc_id", "digest", "size", F.round("mean").cast("long").alias("taken")), "taken")
    i, digest, copies, copy = fresh(docs, "i", "digest", "copies", "copy")
    taken = whole_copies(shared).groupBy(F.col("doc_id").alias(i), F.col("digest").alias(digest)).agg(F.max("copies").alias(copies))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(digest))
    joined = docs.join(taken.hint("merge"), same).filter(F.col(copies) > 0)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(dealt_table(spark, sf_dir, "documents"))
