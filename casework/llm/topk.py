"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are cut into blocks of bounded size inside their tasks. A block keeps one
list per dimension, sorted by that component. A query walks its lists together,
from the end its own sign prefers; every vector met is scored in full, and the
walk stops as soon as the sum of the products at the current depth, the most that
any unseen vector can reach, is below the kth score (equal scores go on, because a
smaller id wins a tie). The best k of each block meet in one ranking per query.

Scale: vectors are read once and never shuffled. Queries are a table in the shared
folder, streamed in bounded batches by every task, so neither side has to fit in
memory or pass through the driver; what is shuffled is k rows per query and block.

Components become floor(scale * x), with x as double, and scores are whole numbers.
Defined results: vectors that are null, or hold a null or non-finite component,
take no part; vectors of unequal length are not compared; an empty vector scores 0
with empty ones; every row but those with the query's own id is a candidate, each
repeated row by itself; a repeated query id counts once, with its smallest vector;
null ids take no part; scores beyond a long are held at its limits; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.shared import locate
from casework.session import scratch_path

BLOCK = 4096  # vectors that one set of sorted lists holds
QUERY_BATCH = 512  # queries held at a time
LONG = (-(1 << 63), (1 << 63) - 1)


class Block:
    """Vectors of equal length with a list of places for each dimension, ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.largest = int(np.abs(vectors.astype(object)).max()) if vectors.size else 0
        self.doubles = vectors.astype(np.float64)

    def scores(self, places: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        if exact:  # every partial sum is a whole number below 2**53
            return self.doubles[places] @ query.astype(np.float64)
        return np.array([sum(int(a) * int(b) for a, b in zip(self.vectors[p], query)) for p in places], object)

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The best (score, id) pairs, by score and then smaller id, without the query's own id."""
        n = len(self.ids)
        bound = self.largest * int(np.abs(query.astype(object)).max() if len(query) else 0) * max(len(query), 1)
        exact = bound < 1 << 53
        used = np.flatnonzero(query)
        best: list[tuple[int, int]] = []
        seen = np.zeros(n, bool)
        depth, step = 0, 16
        if not len(used):
            best = [(0, int(i)) for i in np.sort(self.ids[self.ids != own])[:k]]
            return best
        ahead = query[used] > 0
        while depth < n:
            upto = min(n, depth + step)
            low, high = self.order[used, depth:upto], self.order[used, n - upto : n - depth]
            met = np.unique(np.where(ahead[:, None], high, low))
            fresh = met[~seen[met]]
            seen[fresh] = True
            fresh = fresh[self.ids[fresh] != own]
            if len(fresh):
                found = self.scores(fresh, query, exact)
                if len(fresh) > 4 * k and exact:  # only scores that can rank; ties stay
                    least = np.partition(found, len(found) - k)[len(found) - k]
                    fresh, found = fresh[found >= least], found[found >= least]
                best += [(int(s), int(i)) for s, i in zip(found, self.ids[fresh])]
                best = sorted(best, key=lambda b: (-b[0], b[1]))[:k]
            depth, step = upto, 2 * step
            last = np.where(ahead, self.order[used, n - depth], self.order[used, depth - 1])
            limit = sum(int(a) * int(b) for a, b in zip(query[used], self.vectors[last, used]))
            if len(best) == k and best[-1][0] > limit:
                break
        return best


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """(id, v) with whole-number components; rows that take no part are left out."""
    raw = F.col(vector_column).cast("array<double>")
    usable = F.col(id_column).isNotNull() & raw.isNotNull()
    broken = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(raw, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    picked = vectors.select(F.col(id_column).cast("long").alias("id"), F.when(usable & ~broken, whole).alias("v"))
    return picked.where(F.col("v").isNotNull())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of at most BLOCK vectors of one length."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def close(rows: list[tuple[int, np.ndarray]]) -> Block:
        return Block(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1))

    for batch in batches:
        for i, v in zip(batch.column(0).to_numpy(), batch.column(1)):
            rows = held.setdefault(len(v), [])
            rows.append((int(i), v.values.to_numpy()))
            if len(rows) == BLOCK:
                yield close(held.pop(len(v)))
        if len(held) > 64:  # many lengths: the fullest go first
            fullest = max(held, key=lambda d: len(held[d]))
            yield close(held.pop(fullest))
    for rows in held.values():
        yield close(rows)


def top_k(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    scale: int = 1024,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's best k by inner product, exactly."""
    spark = vectors.sparkSession
    asked = whole_vectors(queries, id_column, vector_column, scale).groupBy("id").agg(F.min("v").alias("v"))
    place = scratch_path(spark, "queries")
    asked.write.parquet(place)
    files = sorted(spark.read.schema("id long, v array<bigint>").parquet(place).inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            width = block.vectors.shape[1]
            for name in files:
                system, path = locate(name)
                with system.open_input_file(path) as source:
                    for asked_now in pq.ParquetFile(source).iter_batches(QUERY_BATCH):
                        rows = []
                        for i, v in zip(asked_now.column(0).to_pylist(), asked_now.column(1)):
                            if len(v) == width:
                                rows += [(i, c, min(max(s, LONG[0]), LONG[1])) for s, c in block.top(v.values.to_numpy(), i, k)]
                        columns = list(zip(*rows)) if rows else [(), (), ()]
                        arrays = [pa.array(c, pa.int64()) for c in columns]
                        yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    found = whole_vectors(vectors, id_column, vector_column, scale).mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
