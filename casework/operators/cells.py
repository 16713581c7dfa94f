"""Nearest neighbours through a stored index of cells, exact by bounds.

``write_cells`` fits centroids to a bounded sample, puts every vector into the cell of its nearest
centroid and stores the cells as partitions, with each cell's radius. ``search_cells`` looks into a
query's nearest cells first; a further cell is read only if a vector in it could still rank, which the
radius bounds: a product is at most q.c + |q| r, a distance at least |q - c| - r. On vectors that form
groups most cells stay unread; on vectors without any the second look reads all of them, and the result
is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.operators.retrieve import match_tiles
from casework.session import cut_lineage

SAMPLE_ROWS = 50_000
SLACK = 1e-6  # rounding of bounds and scores


def write_cells(vectors: DataFrame, path: str, cells: int = 256, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> None:
    """Store (id, embedding, ...) under *path* in at most *cells* cells; every vector is indexed.

    The centroids are fitted to about *sample_rows* vectors. Rows without a vector are left out.
    Cells of many rows become several files, small ones share a task.
    """
    if "cell" in vectors.columns or "gap" in vectors.columns:
        raise ValueError("columns kept for the index: cell, gap")
    spark = vectors.sparkSession
    rows = vectors.filter("embedding IS NOT NULL")
    total = rows.count()
    centres: list = []
    if total:
        sample = rows.sample(min(1.0, sample_rows / total), seed) if total > sample_rows else rows
        features = cut_lineage(sample.select(F.col("embedding").cast("array<double>").alias("x")), "cell-sample")
        fitted = KMeans(k=max(1, min(cells, total)), seed=seed, maxIter=10, featuresCol="v").fit(
            features.select(array_to_vector("x").alias("v"))
        )
        centres = [[float(x) for x in c] for c in fitted.clusterCenters()]  # at most *cells* rows

    @F.pandas_udf("cell int, gap double")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = np.asarray(centres)
        for part in parts:
            x = np.asarray(part.tolist(), dtype="float64").reshape(len(part), -1)
            own = ((c * c).sum(1)[None, :] - 2 * (x @ c.T)).argmin(1) if len(x) else np.zeros(0, int)
            gap = np.sqrt(((x - c[own]) ** 2).sum(1)) if len(x) else np.zeros(0)
            yield pd.DataFrame({"cell": own.astype("int32"), "gap": gap})

    nearest = nearest.asNondeterministic()  # computed once, not once per field
    placed = rows.withColumn("_near", nearest(F.col("embedding").cast("array<double>")))
    placed = placed.select(*vectors.columns, "_near.cell", "_near.gap")
    placed.limit(0).write.parquet(f"{path}/schema")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    known = spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
    sizes = _rows(spark, path).groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    sizes.join(F.broadcast(known), "cell").write.parquet(f"{path}/cells")


def _rows(spark, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def search_cells(
    queries: DataFrame, path: str, k: int = 5, metric: str = "ip", probes: int = 8, exact: bool = True
) -> DataFrame:
    """(query_id, id, score, rank): the k best stored vectors of every query (id, embedding; ids are unique).

    Rows equal those of ``top_k``. Without *exact* only the *probes* nearest cells are read, which may lose some.
    """
    if metric not in ("ip", "l2"):
        raise ValueError("metric is ip or l2")
    spark = queries.sparkSession
    stored = _rows(spark, path)
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, id {stored.schema['id'].dataType.simpleString()}, score double"
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most the index's number of cells
    if not cells:
        return spark.createDataFrame([], schema + ", rank int")
    numbers, centres, radii = [r.cell for r in cells], [r.centre for r in cells], [r.radius for r in cells]

    @F.pandas_udf("near array<int>, far array<struct<cell:int,bound:double>>")
    def order(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, r = np.asarray(centres), np.asarray(radii)
        for part in parts:
            near, far = [], []
            for q in np.asarray(part.tolist(), dtype="float64").reshape(len(part), -1):
                if metric == "ip":
                    close = c @ q
                    bound = close + np.sqrt(q @ q) * r
                else:
                    away = np.sqrt(((c - q) ** 2).sum(1))
                    close, bound = -away, -(np.maximum(away - r, 0) ** 2)
                places = np.argsort(-close, kind="stable")
                near.append([numbers[i] for i in places[:probes]])
                far.append([{"cell": numbers[i], "bound": float(bound[i])} for i in places[probes:]])
            yield pd.DataFrame({"near": near, "far": far})

    asked = queries.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = asked.withColumn("_cells", order.asNondeterministic()("embedding")).select("id", "embedding", "_cells.near", "_cells.far")
    asked = cut_lineage(asked, "cell-queries")

    def look(wanted: DataFrame) -> DataFrame:
        return match_tiles(wanted.select("id", "embedding", "cell"), stored.select("id", "embedding", "cell"), "cell", k, metric, None, schema)

    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = best(look(asked.withColumn("cell", F.explode("near"))))
    if not exact:
        return first
    first = cut_lineage(first, "cell-hits")
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("_least"))
    # with fewer than k hits so far every cell can add one
    open_cells = asked.join(least, "id", "left").select("id", "embedding", "_least", F.inline("far"))
    open_cells = open_cells.filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - SLACK * (1 + F.abs("_least"))))
    return best(first.drop("rank").unionByName(look(open_cells)))
