"""How evenly rows spread over classes, and what to do about it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions.numbers import round_even, share

IMBALANCED, SEVERE = 5.0, 20.0


def class_counts(df: DataFrame, col: str) -> DataFrame:
    label = F.coalesce(F.col(col).cast("string"), F.lit("Unknown"))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def class_shares(df: DataFrame, col: str) -> DataFrame:
    counts = class_counts(df, col)
    total = counts.agg(F.sum("n").alias("n"))
    return counts.withColumn("share", round_even(F.col("n") / total.scalar(), 6))


def balance_report(df: DataFrame, col: str) -> DataFrame:
    """One row: class extremes, their ratio, the verdict on it and advice."""
    counts = class_counts(df, col)
    # extremes by (count, label): the first label wins among equals
    rank_low, rank_high = F.struct("n", "label"), F.struct(-F.col("n"), F.col("label"))
    row = counts.agg(
        F.count("*").alias("classes"),
        F.sum("n").alias("total"),
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
        F.min_by("label", rank_high).alias("majority"),
        F.min_by("label", rank_low).alias("minority"),
    )
    ratio = F.col("max_n") / F.greatest("min_n", F.lit(1))
    row = row.withColumn("ratio", ratio)
    row = row.withColumns(
        {"imbalanced": F.col("ratio") > IMBALANCED, "severely_imbalanced": F.col("ratio") > SEVERE}
    )
    return row.withColumn("advice", _advice()).withColumn("ratio", round_even(F.col("ratio"), 4))


def _advice() -> Column:
    # format_number rounds the binary value, halves to even; format_string would round its decimal text up
    ratio = F.replace(F.format_number("ratio", 1), F.lit(","), F.lit(""))
    weights = F.concat(F.lit("use balanced class weights (ratio "), ratio, F.lit("x)"))
    merge = F.format_string("minority class '%s' has only %d rows: merge rare classes", "minority", "min_n")
    oversample = F.lit("oversample minority classes or undersample the majority class")
    general = (F.lit("judge by macro F1, not accuracy"), F.lit("split train, validation and test by class"))
    return (
        F.when(~F.col("imbalanced"), F.array(F.lit("no special strategy needed")))
        .when(F.col("severely_imbalanced"), F.array(weights, oversample, merge, *general))
        .otherwise(F.array(weights, *general))
    )


def class_weights(df: DataFrame, col: str) -> DataFrame:
    """(label, weight): inverse frequency, scaled to mean 1 over the classes."""
    counts = class_counts(df, col)
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.avg(1 / F.col("n")).alias("mean"))
    # total/(k*n) over its mean; total and k cancel out
    mean = totals.select("mean").scalar()
    return counts.select("label", round_even(1 / F.col("n") / mean, 6).alias("weight"))


def balance_tree(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Per pair: counts, shares and flags of the parent, of the child within it, and warnings."""
    pairs = df.groupBy(F.col(parent).alias("parent"), F.col(child).alias("child")).agg(
        F.count("*").alias("n")
    )
    per_parent = pairs.groupBy("parent").agg(F.sum("n").alias("parent_n"))
    facts = per_parent.agg(F.sum("parent_n").alias("total"), F.max("parent_n").alias("largest"))
    total, largest = facts.select("total").scalar(), facts.select("largest").scalar()
    pairs = pairs.withColumn("parent_n", F.sum("n").over(W.partitionBy("parent")))
    p, c = share(F.col("parent_n"), total, 1), share(F.col("n"), F.col("parent_n"), 1)

    def flag(percent: Column, ok: float) -> Column:
        return F.when(percent >= ok, "OK").when(percent >= 5, "MODERATE").otherwise("MINORITY")

    return pairs.withColumns(
        {
            "parent_percent": p,
            "percent": c,
            "parent_flag": flag(p, 10),
            "flag": flag(c, 15),
            "dominant": p > 25,
            "overweight": c > 75,
            "ratio": round_even(largest / F.col("parent_n"), 1),
        }
    )


def level_imbalance(df: DataFrame, branch: str, label: str, least: int = 30) -> DataFrame:
    """Per branch: ratio of the largest to the smallest class, its severity, classes under *least* rows."""
    counts = (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.col(branch).alias("branch"), F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    row = counts.groupBy("branch").agg(
        F.count("*").alias("classes"),
        F.sum("n").alias("total"),
        (F.max("n") / F.min("n")).alias("ratio"),
        F.count_if(F.col("n") < least).alias("small_classes"),
    )
    severity = F.when(F.col("ratio") > 50, "SEVERE").when(F.col("ratio") > 10, "HIGH").otherwise("OK")
    return row.withColumn("severity", severity).withColumn("ratio", round_even(F.col("ratio"), 1))


def class_list_counts(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Counts for every class of a given list, zero included."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    return every.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
