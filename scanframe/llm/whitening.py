"""Embedding whitening by TSQR: principal axes without forming a covariance matrix.

The distinct vectors are summed exactly, each partition of the centred rows is brought to its
R factor block by block, R factors are merged as a tree, and the singular vectors of the last
one are the components. What reaches the driver or all tasks is one number a dimension, or a
square of the dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, materialise

COMPONENTS = 16
#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more have no exact x and count as non-finite.
LARGEST = 2.0**50
#: R factors that one task merges.
FAN = 16
#: Rows of a block are at least so many, and at least four times the dimensions.
BLOCK = 1024
_EPS = float(np.finfo(np.float64).eps)


class Centre(NamedTuple):
    """The fit list's size and sums: a sum is ``n * whole + rest``, with 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit where that is wide enough, else Python's integers."""
        off = x - self.whole
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < 2**62:
            return off * self.n - self.rest
        return off.astype(object) * self.n - self.rest.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision."""
        return (x - self.whole).astype(np.float64) - self.rest / self.n


class Axes(NamedTuple):
    """Components by falling variance; ``scaled`` has those divided by their deviation."""

    values: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray


def quantised(rows: DataFrame, *keep: str) -> DataFrame:
    """``keep, x`` of the rows that take part: no nulls, no non-finite entries."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(LARGEST)))
    x: Column = F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(SHIFT))
    return rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole).select(*keep, x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(fit: DataFrame) -> Centre:
    """Exact sums: a partition's come as decimals, halves of 32 bits being summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n += len(x)
                total = total + (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in total]])], ["n", "sums"])

    parts = fit.mapInArrow(run, "n long, sums array<string>")
    each = parts.select("n", F.posexplode("sums").alias("k", "s"))
    found = each.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    n, exact = (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])
    return Centre(n, np.array([s // n for s in exact], np.int64), np.array([s % n for s in exact], np.int64))


def _tree(parts: DataFrame, n: int, schema: str, join: Callable[[list[tuple], list[tuple]], tuple]) -> list[tuple]:
    """Rows ``slot, ...`` joined FAN at a time, by slots next to each other, until one is left."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        rows = [tuple(r[c] for c in names) for r in sorted(table.to_pylist(), key=lambda r: r["slot"])]
        last = reduce(join, (r[1:] for r in rows))
        return pa.table([pa.array([v], t) for v, t in zip((rows[0][0] // FAN, *last), table.schema.types, strict=True)], names=names)

    while n > 1:
        n = -(-n // FAN)
        parts = parts.withColumn("group", F.floor(F.col("slot") / FAN)).groupBy("group").applyInArrow(lambda _, t: run(t.select(names)), schema)
    rows = [tuple(r)[1:] for r in parts.orderBy("slot").collect()]
    return [reduce(join, rows)] if rows else []


def axes(fit: DataFrame, centre: Centre, components: int = COMPONENTS) -> Axes:
    """The components of the centred rows of ``fit``, from its R factors."""
    d = len(centre.whole)

    def upper(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.empty((0, d)), [], 0
        for b in batches:
            if b.num_rows:
                held.append(centre.centred(matrix(b.column(0))))
                size += b.num_rows
            if size >= max(BLOCK, 4 * d):
                r, held, size = upper(np.vstack([r, *held])), [], 0
        if held or len(r):
            r = upper(np.vstack([r, *held]))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])], ["slot", "r"])

    def join(a: tuple, b: tuple) -> tuple:
        return (upper(np.vstack([np.array(v).reshape(-1, d) for v in (a[0], b[0])])).ravel().tolist(),)

    parts = fit.mapInArrow(run, "slot long, r array<double>")
    ((r,),) = _tree(parts, fit.rdd.getNumPartitions(), "slot long, r array<double>", join)
    _, s, right = np.linalg.svd(np.array(r).reshape(-1, d))
    s = np.concatenate([s, np.zeros(d - len(s))])
    total, kept = float((s**2).sum()), min(components, d)
    right = right[:kept] * np.where(right[np.arange(kept), np.abs(right[:kept]).argmax(1)] < 0, -1.0, 1.0)[:, None]
    s = np.where(s > s[0] * 64 * d * _EPS, s, 0.0)[:kept]
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(s > 0, right.T * (np.sqrt(centre.n) / s), np.nan)
    return Axes(s**2 / centre.n, scaled, s**2 / total if total else np.full(kept, np.nan))


def identity_error(fit: DataFrame, centre: Centre, found: Axes) -> float | None:
    """Largest entry, in size, of the whitened rows' covariance less the identity; centred first.

    A part's count, mean and scatter are joined with another's without their sums, which would
    cancel. Components without variance are left out; None if no other is left.
    """
    live = found.scaled[:, found.values > 0]
    k = live.shape[1]
    if not k:
        return None

    def join(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], np.subtract(b[1], a[1])
        scatter = np.add(a[2], b[2]) + np.outer(apart, apart).ravel() * (a[0] * b[0] / n)
        return n, (np.array(a[1]) + apart * (b[0] / n)).tolist(), scatter.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = None
        for b in batches:
            if b.num_rows:
                w = centre.centred(matrix(b.column(0))) @ live
                mean = w.mean(0)
                w -= mean
                own = (len(w), mean.tolist(), (w.T @ w).ravel().tolist())
                so_far = join(so_far, own) if so_far else own
        if so_far:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (TaskContext.get().partitionId(), *so_far)], ["slot", "n", "mean", "scatter"])

    schema = "slot long, n long, mean array<double>, scatter array<double>"
    ((n, _, scatter),) = _tree(fit.mapInArrow(run, schema), fit.rdd.getNumPartitions(), schema, join)
    return float(np.abs(np.array(scatter).reshape(k, k) / n - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each input row that takes part and each component.

    Vectors that are null, empty, or hold null, NaN, infinite or huge (LARGEST) entries are dropped, and those
    of another dimension than the most frequent (of these the smallest). With fewer dimensions
    than ``components`` there are as many rows as dimensions. A component without variance has a
    null ``whitened`` and explains 0; if no vector differs from another, ``explained`` and
    ``identity_error`` are null. A deviation over 64 bits is null. Null ids are kept, repeated rows
    give repeated results, equal vectors count once in the fit, extra columns are ignored, an
    empty table gives no rows.
    """
    spark = rows.sparkSession
    sizes = quantised(rows).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    own = quantised(rows, "vec_id").filter(F.size("x") == sizes[0]["d"])
    fit = materialise(own.select("x").distinct(), "fit")
    centre = sums(fit)
    found = axes(fit, centre, components)
    error, kept = identity_error(fit, centre, found), len(found.values)
    explained = pa.array(found.explained, from_pandas=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1))
            off = centre.deviations(x)
            if off.dtype != object and int(np.abs(off).max()) ** 2 * off.shape[1] >= 2**63:
                off = off.astype(object)
            squares = [int(v) if v < 2**63 else None for v in (off * off).sum(1)]
            rows_of = np.repeat(np.arange(len(x)), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows_of), centre.n)),
                    pa.array(squares, pa.int64()).take(pa.array(rows_of)), pa.array((centre.centred(x) @ found.scaled).ravel(), from_pandas=True),
                    explained.take(pa.array(np.tile(np.arange(kept), len(x)))), pa.array([error] * len(rows_of), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, SCHEMA)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(dealt_table(spark, sf_dir, "embeddings"))
