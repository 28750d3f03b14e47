"""Substring dedup: recurring passages confirmed by hash, located by Aho-Corasick automata.

Documents are dealt to blocks of bounded size, and each block sees the whole corpus through
two exchanges of sorted hash arrays:

1. A block sends its anchors, one for every few words: of the short word groups in a window
   the one with the least hash, so equal windows have equal anchors. Shards of the hash space
   answer which anchors recur.
2. For windows with a recurring anchor a block sends 128-bit hashes with the smallest doc_id
   that has them. Shards confirm what recurs and answer which windows a smaller doc_id of
   another block has.

Each block then cuts its confirmed passages into windows-long phrases, compiles them into its
shard of the automata, and streams its documents through it to mark every occurrence. A block
sends a phrase once, however often it has it, so no phrase makes a task large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table

WINDOW = 13
#: Words of an anchor: an anchor is sent for about every (WINDOW - ANCHOR + 2) / 2 words.
ANCHOR = 4
#: Bytes of text in a block, on average.
BLOCK_BYTES = 8 << 20
#: Partitions of blocks; beyond as many a task takes several, one after another.
MOST_PARTITIONS = 1 << 16
_NEVER = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max
_BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _rolled(values: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of n values."""
    out = np.zeros(max(0, len(values) - n + 1), np.uint64)
    for j in range(n):
        out *= base
        out += values[j : j + len(out)]
    return _mixed(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each run of n values."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


class Block:
    """The words of a block's documents as one array, and hashes of its windows."""

    def __init__(self, docs: pa.Table, window: int):
        self.window = window
        self.keys = docs.column("key").to_numpy()
        self.words = [(t.as_py() or b"").split() for t in docs.column("text")]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.stops = np.cumsum(self.sizes)

        class Ids(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = k = len(self)
                return k

        ids = Ids()
        self.flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(self.words)), np.int64, int(self.sizes.sum()))
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
        self.values = hashed[self.flat] if len(ids) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = max(0, len(self.flat) - window + 1)
        self.at = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n else np.empty(0, np.int64)
        self.owner = owner[self.at]
        self.doc = self.keys[self.owner]

    def anchors(self) -> np.ndarray:
        if not len(self.at):
            return np.empty(0, np.uint64)
        return _least(_rolled(self.values, ANCHOR, _BASES[0]), self.window - ANCHOR + 1)[self.at]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return _rolled(self.values, self.window, _BASES[1])[self.at], _rolled(self.values, self.window, _BASES[2])[self.at]


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _dealt(to: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """(receiver, its slice of each array as bytes) for each receiver in ``to``."""
    order = np.argsort(to, kind="stable")
    to, arrays = to[order], [a[order] for a in arrays]
    edges = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1), len(to)] if len(to) else []
    for a, b in pairwise(edges):
        yield int(to[a]), [x[a:b].tobytes() for x in arrays]


def _messages(to: np.ndarray, arrays: list[np.ndarray], sender: int, names: list[str]) -> pa.Table:
    rows = list(_dealt(to, arrays))
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([sender] * len(rows), pa.int64())]
    columns += [pa.array([r[1][k] for r in rows], pa.binary()) for k in range(len(arrays))]
    return pa.table(columns, names=["to", "sender", *names])


def _senders(table: pa.Table, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(table.column("sender").to_numpy(), sizes)


def _counts(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.fromiter((len(x.as_buffer()) // width for x in column), np.int64, len(column))


def send_anchors(docs: pa.Table, window: int, shards: int) -> pa.Table:
    """Distinct anchors of a block, each with whether two of its documents have it."""
    block = Block(docs, window)
    anchors, doc = block.anchors(), block.doc
    if len(anchors):
        new = np.r_[True, (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])]
        anchors, doc = anchors[new], doc[new]
        order = np.argsort(anchors, kind="stable")
        anchors, doc = anchors[order], doc[order]
        starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        anchors = anchors[starts]
    else:
        several = np.empty(0, bool)
    to = (anchors % np.uint64(shards)).astype(np.int64)
    return _messages(to, [anchors, several], docs.column("block")[0].as_py(), ["a", "b"])


def answer_anchors(messages: pa.Table) -> pa.Table:
    """To each block, those of its anchors that two documents have."""
    anchors, several = _joined(messages.column("a"), np.uint64), _joined(messages.column("b"), np.bool_)
    sender = _senders(messages, _counts(messages.column("a"), 8))
    order = np.argsort(anchors, kind="stable")
    anchors, several, sender = anchors[order], several[order], sender[order]
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    counts = np.diff(np.r_[starts, len(anchors)])
    recurs = np.repeat((counts > 1) | np.logical_or.reduceat(several, starts), counts)
    return _messages(sender[recurs], [anchors[recurs]], 0, ["a"])


def send_windows(docs: pa.Table, answers: pa.Table, window: int, shards: int) -> pa.Table:
    """Distinct windows with a recurring anchor, and the block's smallest doc_id with each."""
    block = Block(docs, window)
    recurring = np.sort(_joined(answers.column("a"), np.uint64))
    anchors = block.anchors()
    if len(recurring) and len(anchors):
        found = recurring[np.minimum(np.searchsorted(recurring, anchors), len(recurring) - 1)] == anchors
        one, two = (h[found] for h in block.hashes())
        doc = block.doc[found]
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
        one, two, doc = one[new], two[new], doc[new]
    else:
        one, two, doc = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    to = (one % np.uint64(shards)).astype(np.int64)
    return _messages(to, [one, two, doc], docs.column("block")[0].as_py(), ["a", "b", "c"])


def answer_windows(messages: pa.Table) -> pa.Table:
    """To each block, those of its windows that a smaller doc_id of another block has."""
    one, two = _joined(messages.column("a"), np.uint64), _joined(messages.column("b"), np.uint64)
    doc = _joined(messages.column("c"), np.int64)
    sender = _senders(messages, _counts(messages.column("a"), 8))
    order = np.lexsort((doc, two, one))
    one, two, doc, sender = one[order], two[order], doc[order], sender[order]
    starts = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    first = np.repeat(doc[starts], np.diff(np.r_[starts, len(one)]))
    later = doc > first
    return _messages(sender[later], [one[later], two[later]], 0, ["a", "b"])


def phrases(block: Block, answers: pa.Table) -> dict[tuple[int, ...], int]:
    """Phrases of the confirmed passages, each with the smallest doc_id that has it.

    A passage is a run of windows that a smaller doc_id has; it is cut into window-long
    phrases, end to end, the last one flush with its end, which cover all its words.
    """
    one, two = block.hashes()
    if not len(one):
        return {}
    order = np.argsort(one, kind="stable")
    starts = np.flatnonzero(np.r_[True, one[order][1:] != one[order][:-1]])
    first = np.empty(len(one), np.int64)
    first[order] = np.repeat(np.minimum.reduceat(block.doc[order], starts), np.diff(np.r_[starts, len(one)]))
    outside = _joined(answers.column("a"), np.uint64)
    if len(outside):
        check = _joined(answers.column("b"), np.uint64)
        by = np.argsort(outside, kind="stable")
        outside, check = outside[by], check[by]
        k = np.minimum(np.searchsorted(outside, one), len(outside) - 1)
        first[(outside[k] == one) & (check[k] == two)] = _NEVER
    covered = np.flatnonzero(first < block.doc)
    out: dict[tuple[int, ...], int] = {}
    if not len(covered):
        return out
    breaks = (np.diff(block.at[covered]) != 1) | (np.diff(block.owner[covered]) != 0)
    run_starts = np.r_[0, np.flatnonzero(breaks) + 1]
    run_stops = np.r_[run_starts[1:], len(covered)]
    for a, b in zip(run_starts.tolist(), run_stops.tolist(), strict=True):
        for w in (*range(a, b, block.window), b - 1):
            at = int(block.at[covered[w]])
            out[tuple(block.flat[at : at + block.window].tolist())] = int(first[covered[w]])
    return out


#: Letters that spell a word's number at each of its three places, at least.
LETTERS = 64


def spelling(numbers: np.ndarray, letters: int) -> np.ndarray:
    """Three letters for each word number from 0; for negative ones a letter of their own.

    A node of the automaton looks for a letter among its children one by one, and one with a
    child for every first word would be slow; so words are spelled. Each place has letters of
    its own, so that a match can only start where a word does.
    """
    places = [numbers // letters**2, numbers // letters % letters + letters, numbers % letters + 2 * letters]
    spelled = np.stack(places, axis=1) + 0x100
    spelled[numbers < 0] = 0x100 + 3 * letters
    return spelled.astype("<u4")


class Locator:
    """An Aho-Corasick automaton over the phrases of one block."""

    def __init__(self, found: dict[tuple[int, ...], int]):
        import ahocorasick

        used = np.unique(np.fromiter(chain.from_iterable(found), np.int64))
        self.letters = max(LETTERS, int(len(used) ** (1 / 3)) + 1)
        self.number = np.full(int(used[-1]) + 2, -1, np.int64)  # the last is for all later words
        self.number[used] = np.arange(len(used))
        self.automaton = ahocorasick.Automaton()
        for words, first in found.items():
            self.automaton.add_word(self.spelled(np.array(words)), first)
        self.automaton.make_automaton()

    def spelled(self, words: np.ndarray) -> str:
        numbers = self.number[np.minimum(words, len(self.number) - 1)]
        return spelling(numbers, self.letters).tobytes().decode("utf-32-le")

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(index of the last word, smallest doc_id) of every occurrence of a phrase."""
        for end, first in self.automaton.iter(text):
            yield end // 3, first


def remove(docs: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    """The block's documents without the words that its phrases cover."""
    block = Block(docs, window)
    found = phrases(block, answers)
    locator = Locator(found) if found else None
    text = locator.spelled(block.flat) if locator else ""
    removed, kept = [], []
    for k, words in enumerate(block.words):
        n = 0
        if locator and len(words) >= window:
            keep = np.ones(len(words), bool)
            key, stop = int(block.keys[k]), int(block.stops[k])
            for end, first in locator.matches(text[3 * (stop - len(words)) : 3 * stop]):
                if first < key:
                    keep[end - window + 1 : end + 1] = False
            n = len(words) - int(keep.sum())
            if n:
                words = compress(words, keep.tolist())
        removed.append(n)
        kept.append(b" ".join(words))
    columns = [docs.column("doc_id"), pa.array(block.sizes), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return pa.table(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def drop_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept`` (words joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document with a
    smaller doc_id. Null text has no words. Rows with one doc_id are one document as to each
    other; a null doc_id counts as larger than any. Extra columns are ignored; an empty table
    gives no rows. Rows of one doc_id, or without one, are dealt by their texts, as what is
    removed does not depend on which block a row lies in.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    doc_id = F.col("doc_id").cast("long")
    dealt = docs.select(block.alias("block"), doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("key"), F.col("text").cast("binary").alias("text"))
    # a partition a block, about, so that what a task reads does not grow with the corpus
    fewest = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2, min(blocks, max(fewest, min(total // BLOCK_BYTES, MOST_PARTITIONS))))
    by_block = dealt.repartition(parts, "block").groupBy("block")
    wide = "to long, sender long, a binary"

    def anchors(t: pa.Table) -> pa.Table:
        return send_anchors(t, window, blocks)

    def windows(t: pa.Table, answers: pa.Table) -> pa.Table:
        return send_windows(t, answers, window, blocks)

    def drop(t: pa.Table, answers: pa.Table) -> pa.Table:
        return remove(t, answers, window)

    to = lambda messages: messages.repartition(parts, "to").groupBy("to")
    recurring = to(by_block.applyInArrow(anchors, f"{wide}, b binary")).applyInArrow(answer_anchors, wide)
    sent = by_block.cogroup(to(recurring)).applyInArrow(windows, f"{wide}, b binary, c binary")
    confirmed = to(sent).applyInArrow(answer_windows, f"{wide}, b binary")
    return by_block.cogroup(to(confirmed)).applyInArrow(drop, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeats(dealt_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
w AS (SELECT doc_id, i, ws[i:i + 12] AS g FROM s),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM w JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(coalesce(gone, [])) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
