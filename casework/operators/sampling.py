"""Exact stratified splits, folds and samples that hold up on a dominant class.

Ranking rows within a class by a window would put a class holding a third of
all rows into one task. Here each class is cut into pieces by the leading digits
of a digest of the row id; the ranks within a piece come from a window over
(class, piece), and the pieces before it add their counts. The digest is
uniform, so pieces are even whatever the class sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.operators.filters import drop_singleton_classes

PIECE_DIGITS = 2  # 256 pieces per class


def id_digest(row_id: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))


def rank_in_class(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    """Add ``_rank`` (from 1, in digest order within the class) and ``_class_n``."""
    df = df.withColumn("_digest", id_digest(row_id, seed))
    df = df.withColumn("_piece", F.substring("_digest", 1, PIECE_DIGITS))
    sizes = df.groupBy(label, "_piece").agg(F.count("*").alias("_size"))
    in_order = W.partitionBy(label).orderBy("_piece")
    sizes = sizes.select(
        F.col(label).alias("_label"),
        F.col("_piece").alias("_p"),
        (F.sum("_size").over(in_order) - F.col("_size")).alias("_before"),
        F.sum("_size").over(W.partitionBy(label)).alias("_class_n"),
    )
    inside = F.row_number().over(W.partitionBy(label, "_piece").orderBy("_digest", row_id))
    ranked = df.withColumn("_inside", inside)
    # sizes has classes x 256 rows; Spark broadcasts it when that is small, as it nearly always is
    joined = ranked.join(
        sizes, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_piece") == F.col("_p"))
    )
    return joined.withColumn("_rank", F.col("_before") + F.col("_inside")).drop(
        "_digest", "_piece", "_label", "_p", "_before", "_inside"
    )


def stratified_split(
    df: DataFrame, label: str, row_id: str, test: float = 0.15, val: float = 0.15, seed: int = 42
) -> DataFrame:
    """Add ``split``: test, val and train shares exact within each class; singleton classes drop out."""
    ranked = rank_in_class(drop_singleton_classes(df, label), label, row_id, seed)
    n_test = F.rint(F.col("_class_n") * test)
    n_val = F.rint((F.col("_class_n") - n_test) * (val / (1 - test)))
    split = (
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_val, "val")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("_rank", "_class_n")


def stratified_kfold(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..k-1), even within each class."""
    ranked = rank_in_class(df, label, row_id, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_class_n")


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in digest order, the same ones on every run."""
    return df.withColumn("_d", id_digest(row_id, seed)).orderBy("_d", row_id).limit(n).drop("_d")


def sample_per_group(df: DataFrame, group: str, row_id: str, n: int = 1, seed: int = 42) -> DataFrame:
    """n rows of each group in digest order; each task keeps n per group before the exchange."""
    w = W.partitionBy(group).orderBy(id_digest(row_id, seed), row_id)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
