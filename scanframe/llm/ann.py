"""Approximate nearest neighbours: an inverted multi-index over two vector halves.

Each half is quantised on its own, so k centroids a half make k * k cells. A query walks the
cells by rising sum of its two centroid distances, with a heap over centroid pairs, until the
cells hold the share of all vectors that calibration found to reach the wanted recall; what
they hold is reranked by exact distance. Cells of one first-half centroid form a row of the
index, which is what travels: a query's vector goes to a row once, with the cells it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanframe.llm.common import dealt_table, materialise

#: Centroids a half grow with the root of the number of vectors, so that a cell holds about
#: CELL_VECTORS of them, up to MOST_CENTROIDS: a count for each cell must fit the driver.
CELL_VECTORS = 8
MOST_CENTROIDS = 1024
#: Rows that centroids and probing are fitted on, by hash of vec_id, at most about this many.
SAMPLE = 20_000
CALIBRATION_QUERIES = 200
RECALL = 0.94
NEIGHBOURS = 10
QUERY_MODULUS = 100
ITERATIONS = 12
#: Queries that travel together, and vectors of an index row in one block.
QUERY_BLOCK = 256
VECTOR_BLOCK = 2048
#: An index row that holds more than one in PARTS of all vectors is dealt to several tasks; a
#: part has a block at least and MOST_IN_PART vectors at most.
PARTS = 1000
MOST_IN_PART = 1 << 16
#: Queries whose nearest a task holds before it passes them on.
HELD = 50_000


def usable(vector: Column) -> Column:
    """False for null and zero vectors and those with a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1)[None] - 2 * x @ centroids.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = ITERATIONS, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centroids = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centroid(x, centroids)
        counts = np.bincount(own, minlength=len(centroids))
        for j in range(x.shape[1]):
            sums = np.bincount(own, weights=x[:, j], minlength=len(centroids))
            np.divide(sums, counts, out=centroids[:, j], where=counts > 0)
    return centroids


class MultiIndex:
    """Centroids of both halves, the population of each cell, and the share to probe."""

    def __init__(self, first: np.ndarray, second: np.ndarray, dim: int):
        self.first, self.second, self.dim = first, second, dim
        self.half = first.shape[1]
        self.population = np.zeros((len(first), len(second)), np.int64)
        self._counts: list[list[int]] | None = None
        self.share = 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest_centroid(x[:, : self.half], self.first) * len(self.second) + nearest_centroid(x[:, self.half :], self.second)

    def parts(self) -> np.ndarray:
        """How many parts each row of cells is dealt to."""
        size = min(MOST_IN_PART, max(VECTOR_BLOCK, -(-int(self.population.sum()) // PARTS)))
        return np.maximum(1, -(-self.population.sum(axis=1) // size))

    def probe(self, x: np.ndarray, wanted: float) -> list[int]:
        """Non-empty cells by rising summed distance until they hold ``wanted`` vectors."""
        if self._counts is None:
            self._counts = self.population.tolist()
        d1 = ((self.first - x[: self.half]) ** 2).sum(axis=1)
        d2 = ((self.second - x[self.half :]) ** 2).sum(axis=1)
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        population, width = self._counts, len(o2)
        heap, found, held = [(s1[0] + s2[0], 0, 0)], [], 0
        push, pop = heapq.heappush, heapq.heappop
        while heap and held < wanted:
            _, i, j = pop(heap)
            n = population[o1[i]][o2[j]]
            if n:
                found.append(o1[i] * width + o2[j])
                held += n
            # a pair is reached along its row, and the rows start one below the other
            if j + 1 < width:
                push(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                push(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return found

    def count(self, cells: np.ndarray, vectors: np.ndarray | int = 1) -> None:
        """Add vectors to cells."""
        np.add.at(self.population.reshape(-1), cells, vectors)
        self._counts = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_counts": None}


def calibrate(index: MultiIndex, x: np.ndarray, queries: int, neighbours: int, recall: float) -> float:
    """The least share of the sample that its own queries must probe for ``recall``.

    Neighbours in all rows lie closer than those in a sample, so the share suffices there too.
    """
    cells = index.cells(x)
    index.count(cells)
    needed = []
    for q in np.linspace(0, len(x) - 1, min(queries, len(x))).astype(int):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        top = np.argsort(d, kind="stable")[: min(neighbours, len(x) - 1)]
        order = index.probe(x[q], len(x))
        rank = {c: k for k, c in enumerate(order)}
        held = np.cumsum(index.population.reshape(-1)[order])
        needed += [held[rank[c]] for c in cells[top]]
    if not needed:
        return 1.0
    return float(np.quantile(needed, recall, method="higher")) / len(x)


def centroids_for(n: int) -> int:
    """Centroids a half for an index of n vectors."""
    return max(2, min(MOST_CENTROIDS, round((n / CELL_VECTORS) ** 0.5)))


def fit(vectors: DataFrame, k: int | None = None, sample: int = SAMPLE, queries: int = CALIBRATION_QUERIES, neighbours: int = NEIGHBOURS, recall: float = RECALL) -> MultiIndex | None:
    """Fit on about ``sample`` rows; None if no vector is usable.

    The dimension is the most frequent one (of these the smallest). ``k``: centroids a half, by
    default ``centroids_for`` the number of vectors. The driver gets the sample.
    """
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    own = vectors.filter(F.size("v") == dim)
    k = k or centroids_for(n)
    picked = own
    if n > sample:
        picked = own.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < F.lit(int((1 << 30) * sample / n)))
    rows = picked.select("id", "v").toArrow()
    x = matrix(rows.column("v").combine_chunks(), dim)[np.argsort(rows.column("id").to_numpy(), kind="stable")] if rows.num_rows else np.empty((0, dim))
    if not len(x):
        x = matrix(own.select("v").limit(1).toArrow().column("v").combine_chunks(), dim)
    half = max(1, dim // 2)
    second = x[:, half:] if dim > 1 else np.zeros((len(x), 1))
    index = MultiIndex(kmeans(x[:, :half], k), kmeans(second, k, seed=1), dim)
    if dim == 1:
        x = np.hstack([x, second])
    index.share = calibrate(index, x, queries, neighbours, recall)
    return index


def _padded(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros_like(x)]) if x.shape[1] == 1 else x


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], kind)


def _placed(vectors: DataFrame, index: MultiIndex) -> DataFrame:
    """``cell, id, v`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.cells(_padded(matrix(b.column(1), index.dim)))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), b.column(0), b.column(1)], ["cell", "id", "v"])

    return vectors.mapInArrow(run, "cell int, id long, v array<double>")


def _blocks(placed: DataFrame, index: MultiIndex) -> DataFrame:
    """``row, part, cells, ids, vectors``: vectors of a part of an index row, VECTOR_BLOCK at a
    time; ``cells``: the second-half centroid of each."""
    width = len(index.second)
    names = ["row", "part", "cells", "ids", "vectors"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, size = None, 0

        def flush() -> pa.RecordBatch:
            cells, ids, vectors = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), *(_lists([c], pa.binary()) for c in (cells, ids, vectors))], names)

        for b in batches:
            row, part, cell, own = (b.column(k).to_numpy() for k in range(4))
            x = matrix(b.column(4), index.dim)
            edges = [0, *(np.flatnonzero((row[1:] != row[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(row)]
            for a, z in zip(edges, edges[1:], strict=False):
                if a == z:
                    continue
                key = (int(row[a]), int(part[a]))
                if size and key != at:
                    yield flush()
                    size = 0
                at = key
                while a < z:
                    n = min(z - a, VECTOR_BLOCK - size)
                    held.append(((cell[a : a + n] % width).astype(np.int32), own[a : a + n], x[a : a + n]))
                    size, a = size + n, a + n
                    if size == VECTOR_BLOCK:
                        yield flush()
                        size = 0
        if size:
            yield flush()

    row = F.floor(F.col("cell") / width).cast("int")
    parts = index.parts()
    many = {int(c): int(parts[c]) for c in np.flatnonzero(parts > 1)}  # at most one a centroid
    part = F.lit(0)
    if many:
        count = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in many.items() for v in pair]), row), F.lit(1))
        part = F.pmod(F.xxhash64("id"), count).cast("int")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select(row.alias("row"), part.alias("part"), "cell", "id", "v").repartition(n, "row", "part").sortWithinPartitions("row", "part", "cell", "id")
    return dealt.mapInArrow(run, "row int, part int, cells binary, ids binary, vectors binary")


def _probes(queries: DataFrame, index: MultiIndex, total: int) -> DataFrame:
    """``row, part, query_ids, queries, visits, visited``: for each block of queries, those that
    visit cells of an index row, how many of them, and which."""
    parts = index.parts().tolist()
    wanted, width = index.share * total, len(index.second)
    names = ["row", "part", "query_ids", "queries", "visits", "visited"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERY_BLOCK):
                b = whole.slice(start, QUERY_BLOCK)
                ids, x = b.column(0).to_numpy(), matrix(b.column(1), index.dim)
                found = [np.array(index.probe(q, wanted), np.int64) for q in _padded(x)]
                query = np.repeat(np.arange(len(found)), [len(f) for f in found])
                cell = np.concatenate(found)
                order = np.lexsort((cell, query, cell // width))
                query, cell = query[order], cell[order]
                row = cell // width
                edges = [0, *(np.flatnonzero(row[1:] != row[:-1]) + 1).tolist(), len(row)] if len(row) else []
                rows = []
                for a, z in zip(edges, edges[1:], strict=False):
                    ks, visits = np.unique(query[a:z], return_counts=True)
                    sent = (ids[ks], x[ks], visits.astype(np.int32), (cell[a:z] % width).astype(np.int32))
                    rows += [(int(row[a]), part, *sent) for part in range(parts[int(row[a])])]
                if rows:
                    yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1)), *(_lists([r[k] for r in rows], pa.binary()) for k in range(2, 6))], names)

    # dealt to all tasks: walking the cells takes much work a query
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.repartition(n).mapInArrow(run, "row int, part int, query_ids binary, queries binary, visits binary, visited binary")


def _ranked(joined: DataFrame, index: MultiIndex, neighbours: int) -> DataFrame:
    """``query_id, vec_id, score``: a task's nearest of each query that it meets, each pair of
    id and score once."""
    dim, width = index.dim, len(index.second)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            counts = [len(d) for _, d in best.values()]
            columns = [
                pa.array(np.repeat(np.fromiter(best, np.int64, len(best)), counts)),
                pa.array(np.concatenate([i for i, _ in best.values()])),
                pa.array(np.concatenate([d for _, d in best.values()])),
            ]
            best.clear()
            return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

        seen = np.zeros(width, bool)
        for b in batches:
            for query_ids, queries, visits, visited, cells, ids, vectors in zip(*b.columns, strict=True):
                all_ids, cells = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(cells.as_buffer(), np.int32)
                all_x = np.frombuffer(vectors.as_buffer(), np.float64).reshape(-1, dim)
                visited, stop = np.frombuffer(visited.as_buffer(), np.int32), 0
                asked = zip(np.frombuffer(query_ids.as_buffer(), np.int64).tolist(), np.frombuffer(queries.as_buffer(), np.float64).reshape(-1, dim), np.frombuffer(visits.as_buffer(), np.int32).tolist(), strict=True)
                for q, v, n in asked:
                    own, stop = visited[stop : stop + n], stop + n
                    seen[own] = True
                    mine = np.flatnonzero(seen[cells] & (all_ids != q))
                    seen[own] = False
                    if not len(mine):
                        continue
                    difference = all_x[mine] - v
                    score, near = np.sqrt(np.einsum("ij,ij->i", difference, difference)), all_ids[mine]
                    if q in best:
                        held_ids, held = best[q]
                        if len(held) == neighbours:
                            closer = score <= held[-1]
                            if not closer.any():
                                continue
                            near, score = near[closer], score[closer]
                        near, score = np.concatenate([held_ids, near]), np.concatenate([held, score])
                    order = np.lexsort((near, score))
                    near, score = near[order], score[order]
                    fresh = np.r_[True, (near[1:] != near[:-1]) | (score[1:] != score[:-1])][: len(near)]  # repeats count once
                    best[q] = (near[fresh][:neighbours], score[fresh][:neighbours])
            if len(best) > HELD:
                yield flush()
        if best:
            yield flush()

    columns = ["query_ids", "queries", "visits", "visited", "cells", "ids", "vectors"]
    return joined.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")


def _single(kept: DataFrame) -> DataFrame:
    """Each pair of id and vector once, so that repeats neither fill the places of a query nor
    the share of vectors that it probes. Without repeated ids nothing is shuffled but ids."""
    if not kept.groupBy("id").count().filter("count > 1").limit(1).count():
        return kept
    return materialise(kept.dropDuplicates(["id", "v"]), "vectors")


def search(vectors: DataFrame, neighbours: int = NEIGHBOURS, modulus: int = QUERY_MODULUS, k: int | None = None, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each row whose vec_id is
    divisible by ``modulus``, over all other rows, nearest first, ties to the smaller vec_id.

    Null, zero and non-finite vectors, and those of another dimension than the most frequent,
    take no part; nor do null ids. Rows that repeat a vec_id are candidates but never of each
    other, and repeats of one vector and id count once; of an id with several vectors the least
    one, as arrays compare, is the query. Extra columns are ignored; an empty table, or one
    without a usable vector, gives no rows.
    """
    spark = vectors.sparkSession
    kept = _single(vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v"))))
    index = fit(kept, k, neighbours=neighbours, recall=recall)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = kept.filter(F.size("v") == index.dim)
    placed = _placed(own, index)
    index.population[:] = 0
    counted = placed.groupBy("cell").count().toArrow()  # MOST_CENTROIDS squared rows at most
    index.count(counted.column("cell").to_numpy(), counted.column("count").to_numpy())
    total = int(index.population.sum())
    queries = own.filter(F.col("id") % modulus == 0).groupBy("id").agg(F.min("v").alias("v"))
    joined = _probes(queries, index, total).hint("merge").join(_blocks(placed, index), ["row", "part"])
    best = _ranked(joined, index, neighbours).distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(dealt_table(spark, sf_dir, "embeddings"))
