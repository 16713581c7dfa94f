"""Classification metrics from (true, predicted) label columns.

Rows are counted once per label pair; everything after that works on at most
classes x classes rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions.numbers import round_even


def _pairs(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(true).cast("string").alias("true"), F.col(pred).cast("string").alias("pred")).agg(
        F.count("*").alias("n")
    )


def confusion(df: DataFrame, true: str, pred: str, normalise: bool = False) -> DataFrame:
    """(true, pred, n) for every label pair, zero included; with the row share if asked."""
    pairs = _pairs(df, true, pred)
    labels = pairs.select(F.explode(F.array("true", "pred")).alias("label")).distinct()
    every = labels.agg(F.sort_array(F.collect_set("label")).alias("labels"))  # one entry per class
    grid = labels.select(F.col("label").alias("true"), F.explode(every.scalar()).alias("pred"))
    cells = grid.join(pairs, ["true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not normalise:
        return cells
    total = F.sum("n").over(W.partitionBy("true"))
    return cells.withColumn("share", F.when(total > 0, round_even(F.col("n") / total, 6)).otherwise(0.0))


def _per_label(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Hits, true rows and predicted rows of each label that occurs on either side."""
    pairs = _pairs(df, true, pred)
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("true").alias("label"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("pred").alias("label"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    return sides.groupBy("label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scores(per_label: DataFrame) -> DataFrame:
    return per_label.withColumns(
        {
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
            "f1": _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")),
        }
    )


def metrics_row(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row of unrounded metrics."""
    n = F.sum("support")
    sums = _scores(_per_label(df, true, pred)).agg(
        n.alias("n"),
        (F.sum("hits") / n).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        (F.sum(F.col("support").cast("double") * F.col("predicted")) / (n * n)).alias("chance"),
        F.count_if(F.col("support") > 0).alias("num_classes"),
    )
    kappa = F.when(
        F.col("chance") < 1, (F.col("accuracy") - F.col("chance")) / (1 - F.col("chance"))
    ).otherwise(F.lit(float("nan")))
    return sums.withColumn("cohen_kappa", kappa).withColumn("f1_micro", F.col("accuracy"))


METRICS = (
    "accuracy", "f1_macro", "f1_weighted", "f1_micro", "precision_macro", "recall_macro",
    "cohen_kappa", "support_total", "num_classes",
)


def classification_metrics(df: DataFrame, true: str, pred: str, prefix: str = "") -> DataFrame:
    """(metric, value), six decimals."""
    row = metrics_row(df, true, pred).withColumn("support_total", F.col("n"))
    row = row.select(*[round_even(F.col(m), 6).alias(prefix + m) for m in METRICS])
    return row.unpivot([], [prefix + m for m in METRICS], "metric", "value")


def per_class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, support), then the accuracy, macro and weighted rows."""
    scored = _scores(_per_label(df, true, pred))
    n = F.sum("support")

    def line(label: str, precision: Column, recall: Column, f1: Column):
        return F.struct(
            F.lit(label).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("n").alias("support"),
        )

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / n

    row = scored.agg(
        n.alias("n"),
        (F.sum("hits") / n).alias("acc"),
        *[F.avg(c).alias(f"{c}_m") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"{c}_w") for c in ("precision", "recall", "f1")],
    )
    acc = F.col("acc")
    averages = row.select(
        F.inline(
            F.array(
                line("accuracy", acc, acc, acc),
                line("macro avg", F.col("precision_m"), F.col("recall_m"), F.col("f1_m")),
                line("weighted avg", F.col("precision_w"), F.col("recall_w"), F.col("f1_w")),
            )
        )
    )
    both = scored.select("label", "precision", "recall", "f1", "support").unionByName(averages)
    return both.withColumns({c: round_even(F.col(c), 4) for c in ("precision", "recall", "f1")})


def top_k_accuracy(df: DataFrame, true: str, scores: str, k: int = 3) -> DataFrame:
    """Share of rows whose true label is among the k best of a map label -> score.

    Equal scores rank by label.
    """
    ranked = F.sort_array(
        F.transform(
            F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("label"))
        )
    )
    best = F.transform(F.slice(ranked, 1, k), lambda e: e["label"])
    return df.agg(round_even(F.avg(F.array_contains(best, F.col(true)).cast("int")), 6).alias("top_k_accuracy"))


def split_coverage(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """(label, train, test, missing_from): class counts per split and gaps."""
    counts = df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col(split) == "train").alias("train"), F.count_if(F.col(split) == "test").alias("test")
    )
    gap = F.when(F.col("train") == 0, "train").when(F.col("test") == 0, "test").otherwise("")
    return counts.withColumn("missing_from", gap)


def evaluate_all(df: DataFrame, targets: dict[str, tuple[str, str]]) -> DataFrame:
    """(target, metric, value) for several (true, predicted) column pairs of one table."""
    parts = [
        classification_metrics(df.filter(F.col(t).isNotNull()), t, p).withColumn("target", F.lit(name))
        for name, (t, p) in targets.items()
    ]
    return reduce(DataFrame.unionByName, parts)
