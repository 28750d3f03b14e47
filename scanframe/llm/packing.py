"""Best-fit packing of token sequences: bounded-space online best-fit in each partition."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, in_parts, materialise
from scanframe.llm.tokens import BATCH_BYTES, TOKENIZER, Chunks, loaded, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Bins that a packer holds open.
OPEN_BINS = 4096
#: Pieces that one task packs. With about 2^16 the bins still open at its end weigh little.
PIECES_PER_TASK = 1 << 16
#: Pieces arrive in waves of about this many, each longest first: long ones open bins and short
#: ones fill them, and a wave never needs more bins than may be open.
WAVE = 1 << 12
#: Sequence ids of a task start at a multiple of this.
STRIDE = 1 << 33


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what full pieces leave over."""
    head = length % capacity or min(length, capacity)
    return [(0, head), *((at, capacity) for at in range(head, length, capacity))]


class Packer:
    """Online best-fit with at most ``open_bins`` open bins; the fullest closes first.

    A bitset has a bit for each free space that some open bin has, so the tightest bin that
    takes a piece is the lowest set bit at or above its length.
    """

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[deque[int]] = [deque() for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.popleft()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document cut into pieces."""
    path = path or tokenizer_path(TOKENIZER)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            for b in in_parts(batch, 1, batch_bytes):
                rows = []
                for doc_id, own in zip(b.column(0).to_pylist(), Chunks(model, b.column(1)).ids(), strict=True):
                    ids = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, (at, n) in enumerate(pieces_of(len(ids), capacity)):
                        rows.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n])))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add ``sequence_id long, offset long`` to rows with ``length`` (1 to ``capacity``).

    ``parts`` must be materialised. Rows are dealt round robin, sorted before by Spark so that a
    task that runs again deals the same; so rows that repeat go to different tasks. Each task
    sorts its rows, in waves, and gives the same sequences when it runs again.
    """
    total = parts.count()
    n = max(1, -(-total // per_task))
    names = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(capacity, open_bins), TaskContext.get().partitionId() * STRIDE
        for b in batches:
            placed = [packer.put(x) for x in b.column("length").to_pylist()]
            number, offset = zip(*placed, strict=True) if placed else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + x for x in number], pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    order = F.xxhash64(*names)
    wave = F.pmod(order, F.lit(max(1, total // n // WAVE)))
    dealt = parts.repartition(n).sortWithinPartitions(wave, F.desc("length"), order, *names)
    return dealt.mapInArrow(run, f"{', '.join(f'`{k}` {t}' for k, t in parts.dtypes)}, sequence_id long, offset long")


def best_fit(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then END_ID; null and empty texts are END_ID alone. Only
    documents over CAPACITY are cut. Texts are tokenized once and only lengths and checksums
    are kept. Rows that repeat, and null doc_ids, are packed each on their own; extra columns
    are ignored; an empty table gives no rows.
    """
    return pack(materialise(pieces(docs, path), "pieces"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(dealt_table(spark, sf_dir, "documents"))
