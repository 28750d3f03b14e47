"""Helpers shared by the training-data operators: words, shared tables, skew-safe lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.plans.stages import materialise, shared_dir, spread

__all__ = ["HOT_SHARE", "WHITE_SPACE", "WORD", "dealt_table", "few", "fresh", "in_parts", "lookup", "materialise", "shared_dir", "table"]

#: A word is a run of anything but the six ASCII white-space characters. ``bytes.split()`` on
#: UTF-8 cuts at exactly these; ``str.split()`` would also cut at non-ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"

#: A key that holds more than one in HOT_SHARE of all rows is hot; so there are fewer than
#: HOT_SHARE hot keys, whatever the size of the input.
HOT_SHARE = 1000

#: Rows of a few numbers each that are sent to every task at most: some 50 MB once hashed.
FEW = 1 << 19


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def few(keys: DataFrame) -> DataFrame:
    """``keys``, which must be materialised, to be sent to every task if they are FEW at most; more of
    them meet the other side by shuffle."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As ``table``, a small one dealt to all cores: for what takes much work a row."""
    return spread(table(spark, sf_dir, name))


def lookup(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key; ``weight``: that key's rows).

    ``keyed`` must be materialised, as it is read more than once. Keys with more than one in
    HOT_SHARE of the total weight are joined by broadcast (fewer than HOT_SHARE rows by
    construction), so that no task gets a hot key's rows; all others are joined by shuffle.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = keyed.filter(is_hot)
    if not hot.limit(1).count():
        return rows.join(keyed, key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold_rows.join(keyed.filter(~is_hot), key))


def in_parts(batch: pa.RecordBatch, column: int, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``part_bytes`` bytes of text in ``column`` each, so that what
    a task makes of a part is bounded; a row that is longer is a part of its own."""
    if not batch.num_rows:
        return
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + part_bytes, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
