"""Synthetic minority rows (SMOTE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.operators.retrieve import top_k
from casework.operators.sampling import rank_in_class
from casework.session import cut_lineage


def smote(df: DataFrame, label: str, row_id: str, vector: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows plus new ones that lift every class to the size of the largest.

    A new row lies at a pseudo-random point between a row and one of its k nearest
    neighbours of the same class: x + u (neighbour - x). Classes with a single row
    cannot be lifted. The majority class is never touched. Neighbours are exact;
    the search is tiled inside each class, so no task holds a class and classes
    never meet, but its work grows with the square of a class's rows, as the
    method's does.
    """
    rows = df.select(F.col(row_id).cast("string").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n").alias("n"))
    short = sizes.withColumn("missing", largest.scalar() - F.col("n")).filter((F.col("missing") > 0) & (F.col("n") > 1))
    minority = cut_lineage(rows.join(F.broadcast(short), "label"), "minority")
    ranked = rank_in_class(minority, "label", "id", seed)
    each = F.floor(F.col("missing") / F.col("n")) + F.when(
        F.col("_rank") <= F.col("missing") % F.col("n"), 1
    ).otherwise(0)
    copies = ranked.withColumn("copies", each.cast("int")).filter("copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    near = top_k(minority, minority, k, metric="l2", same="label", skip="id")
    neighbours = near.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"]).alias("near")
    )  # k entries per row
    copies = copies.join(neighbours, copies["id"] == neighbours["query_id"])
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "id", "copy"))

    def part(start: int):
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / float(16**8)

    picked = copies.select(
        F.col("id").alias("parent"),
        "label",
        "copy",
        F.col("embedding").alias("x"),
        F.get("near", F.floor(part(1) * F.size("near")).cast("int")).alias("neighbour"),
        part(9).alias("u"),
    )
    other = minority.select(F.col("id").alias("neighbour"), F.col("embedding").alias("y"))
    made = picked.join(other, "neighbour").select(
        F.concat_ws("~", "parent", "copy").alias("id"),
        "label",
        F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)).alias("embedding"),
        "parent",
        "neighbour",
    )
    blank = F.lit(None).cast("string")
    return rows.withColumns({"parent": blank, "neighbour": blank}).unionByName(made)
