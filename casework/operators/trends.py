"""Counts over years and their extrapolation, for many series at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions.numbers import round_even
from casework.operators.profile import annual_volume, value_counts

HORIZON = 5
LEAST_YEARS_TREND, LEAST_YEARS_AR = 5, 10
BAND = 1.2816  # normal quantile of an 80 % band


def yearly_pivot(df: DataFrame, label: str, values: Sequence[str], year: str = "year_numeric") -> DataFrame:
    """One row per year, one column per given label, zero where nothing happened."""
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(F.col(year).cast("int").alias("year"))
        .pivot(label, list(values))
        .count()
        .na.fill(0)
    )


def yearly_counts(df: DataFrame, label: str, year: str = "year_numeric") -> DataFrame:
    """Long (year, label, n) with a zero for every label of every year."""
    counts = (
        df.filter(F.col(year).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(year).cast("int").alias("year"), F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
    )
    labels = counts.agg(F.sort_array(F.collect_set("label")).alias("l"))  # one entry per label
    grid = counts.select("year").distinct().withColumn("label", F.explode(labels.scalar()))
    return grid.join(counts, ["year", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_label_trends(df: DataFrame, label: str, n: int = 10, year: str = "year_numeric") -> DataFrame:
    """``yearly_counts`` of the n most frequent labels."""
    dated = df.filter(F.col(year).isNotNull())
    top = value_counts(dated, label, n).select(F.col("label").alias(label))
    return yearly_counts(dated.join(F.broadcast(top), label, "left_semi"), label, year)


def forecast_volume(
    df: DataFrame, by: Sequence[str] = (), year: str = "year_numeric", horizon: int = HORIZON
) -> DataFrame:
    """Yearly counts extrapolated per series of *by*: (series.., method, year, forecast, low, high, aic).

    Two models per series, both fitted by regression aggregates: a straight line
    over the years, and a first-order autoregression of the yearly change. Ten
    years allow both, the smaller information criterion per fitted point wins;
    five to nine years allow the line; fewer give no forecast.
    """
    by = list(by)
    if not by:
        df, by = df.withColumn("_series", F.lit("all")), ["_series"]
    series = annual_volume(df, year, *by)
    w = W.partitionBy(*by).orderBy("year")  # a series has one row per year
    y = F.col("n_cases").cast("double")
    series = series.withColumn("y", y).withColumn("d", F.col("y") - F.lag("y").over(w))
    series = series.withColumn("d1", F.lag("d").over(w))
    fits = series.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "year").alias("slope"),
        F.regr_intercept("y", "year").alias("intercept"),
        F.regr_slope("d", "d1").alias("phi"),
        F.regr_intercept("d", "d1").alias("c"),
        F.max("year").alias("last_year"),
        F.max_by("y", "year").alias("last_y"),
        F.max_by("d", "year").alias("last_d"),
    )
    fits = fits.filter(F.col("n") >= LEAST_YEARS_TREND)
    line_error = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("year"))
    ar_error = F.col("d") - (F.col("c") + F.col("phi") * F.col("d1"))
    errors = (
        series.join(fits.select(*by, "slope", "intercept", "phi", "c"), by)
        .groupBy(*by)
        .agg(
            F.sum(line_error * line_error).alias("line_rss"),
            F.sum(ar_error * ar_error).alias("ar_rss"),
            F.count(ar_error).alias("ar_n"),
        )
    )

    def per_point(rss: str, n: str):
        return F.log(F.greatest(F.col(rss), F.lit(1e-9)) / F.col(n)) + 6 / F.col(n)

    models = fits.join(errors, by).withColumns(
        {
            "line_aic": per_point("line_rss", "n"),
            "ar_aic": F.when(
                (F.col("n") >= LEAST_YEARS_AR) & F.col("phi").isNotNull(), per_point("ar_rss", "ar_n")
            ),
        }
    )
    use_ar = F.coalesce(round_even(F.col("ar_aic"), 9) < round_even(F.col("line_aic"), 9), F.lit(False))
    models = models.withColumn("use_ar", use_ar)
    ahead = models.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    line = F.col("intercept") + F.col("slope") * (F.col("last_year") + F.col("h"))
    # change at step i: c + phi * change at step i-1, summed up to h
    path = F.aggregate(
        F.sequence(F.lit(1), F.col("h")),
        F.struct(F.col("last_y").alias("y"), F.col("last_d").alias("d")),
        lambda s, _: F.struct(
            (s["y"] + F.col("c") + F.col("phi") * s["d"]).alias("y"),
            (F.col("c") + F.col("phi") * s["d"]).alias("d"),
        ),
        lambda s: s["y"],
    )
    rss, n = (F.when(F.col("use_ar"), F.col(a)).otherwise(F.col(b)) for a, b in (("ar_rss", "line_rss"), ("ar_n", "n")))
    sigma = F.sqrt(rss / (n - 2))
    value = F.when(F.col("use_ar"), path).otherwise(line)
    return ahead.select(
        *by,
        F.when(F.col("use_ar"), "autoregression").otherwise("trend").alias("method"),
        (F.col("last_year") + F.col("h")).alias("year"),
        round_even(value, 4).alias("forecast"),
        round_even(value - BAND * sigma, 4).alias("low"),
        round_even(value + BAND * sigma, 4).alias("high"),
        round_even(F.when(F.col("use_ar"), F.col("ar_aic")).otherwise(F.col("line_aic")), 4).alias("aic"),
    ).drop("_series")


def timeline(history: DataFrame, forecast: DataFrame, years: int = 20) -> DataFrame:
    """The last years of the history and the rounded forecast, tagged by type."""
    past = history.orderBy(F.desc("year")).limit(years)
    past = past.select("year", F.col("n_cases").cast("bigint").alias("n_cases"), F.lit("history").alias("type"))
    ahead = forecast.select(
        "year", F.rint("forecast").cast("bigint").alias("n_cases"), F.lit("forecast").alias("type")
    )
    return past.unionByName(ahead)
