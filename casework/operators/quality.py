"""Validation of the case table and the summary of an extraction run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions.numbers import round_even, share
from casework.functions.text import is_empty, year_number
from casework.operators.profile import counts_by_section
from casework.schemas import REQUIRED_COLUMNS

# The column and the label that means "not known".
KNOWN = (("verdict", "Verdict Unknown"), ("case_type", "Unclassified"), ("sub_type", "Unclassified"))
LEAST_COVERAGE = 70.0


def validate(df: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """(level, check, n, detail): errors, warnings that apply, and statistics.

    A missing column is an error row and skips the checks on it. One pass over
    the rows plus one distinct count of the ids.
    """
    spark, have = df.sparkSession, set(df.columns)
    missing = [c for c in required if c not in have]
    tests = {"total_rows": F.count("*")}
    if "case_text" in have:
        tests["empty_text"] = F.count_if(is_empty(F.col("case_text")))
    for col, bad in KNOWN:
        if col in have:
            tests[f"{col}_known"] = F.count_if(~F.col(col).eqNullSafe(F.lit(bad)))
    if "year" in have:
        year = year_number(F.col("year"))
        tests["bad_years"] = F.count_if((year < 1600) | (year > 2100))
        tests["min_year"], tests["max_year"] = F.min(year), F.max(year)
    row = df.agg(*[c.cast("bigint").alias(n) for n, c in tests.items()])
    if "case_id" in have:
        ids = df.groupBy("case_id").agg(F.count("*").alias("n"))
        repeats = ids.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
        row = row.withColumn("duplicate_ids", repeats.scalar())

    total = F.col("total_rows")
    lines = [
        F.struct(
            F.lit("error").alias("level"),
            F.lit("missing_columns").alias("check"),
            F.lit(len(missing)).cast("bigint").alias("n"),
            F.lit(", ".join(missing)).alias("detail"),
            F.lit(bool(missing)).alias("applies"),
        ),
        _line("error", "empty_table", F.lit(0), F.lit(""), total == 0),
        _line("stat", "total_rows", total, F.lit(""), F.lit(True)),
    ]
    filled = total > 0
    for name in ("empty_text", "duplicate_ids", "bad_years"):
        if name in row.columns:
            lines.append(_line("warning", name, F.col(name), F.lit(""), filled & (F.col(name) > 0)))
    for col, _ in KNOWN:
        if f"{col}_known" in row.columns:
            known = F.col(f"{col}_known")
            percent = share(known, total, 1)
            text = F.format_string("%d/%d  (%.1f%%)", known, total, percent)
            lines.append(_line("stat", f"{col}_coverage", known, text, filled))
            low = filled & (known / total * 100 < LEAST_COVERAGE)
            lines.append(_line("warning", f"{col}_low_coverage", known, text, low))
    if "year" in have:
        span = F.when(
            F.col("min_year").isNotNull(), F.format_string("%d - %d", "min_year", "max_year")
        ).otherwise("unknown")
        lines.append(_line("stat", "year_range", F.lit(0), span, filled))
    return (
        row.select(F.inline(F.array(*lines)))
        .filter("applies")
        .drop("applies")
    )


def _line(level: str, check: str, n, detail, applies):
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        n.cast("bigint").alias("n"),
        detail.alias("detail"),
        applies.alias("applies"),
    )


def passed(report: DataFrame) -> bool:
    return report.filter("level = 'error'").isEmpty()


def etl_summary(df: DataFrame) -> DataFrame:
    """(section, label, n, percent): the run report's lists, year range, citations and quality.

    The table is read once: every figure comes from the counts per label.
    """
    lists = {"source": "source_folder", "case_type": "case_type", "sub_type": "sub_type", "verdict": "verdict"}
    limits = {"case_type": 10, "sub_type": 15, "verdict": 10}
    sections = {name: F.col(c) for name, c in lists.items()}
    sections["year"] = year_number(F.col("year"))
    sections["citations"] = F.col("num_citations")
    counts = counts_by_section(df, sections)
    label, n = F.col("label"), F.col("n")

    def within(name: str, value):
        return F.when(F.col("section") == name, value)

    number = label.try_cast("bigint")
    row = counts.agg(
        F.sum(within("source", n)).alias("total"),
        F.min(within("year", number)).alias("min_year"),
        F.max(within("year", number)).alias("max_year"),
        F.sum(within("citations", number * n)).alias("citations"),
        F.sum(within("citations", F.when(number.isNotNull(), n))).alias("counted"),
        *[F.sum(within(c, F.when(~label.eqNullSafe(F.lit(bad)), n).otherwise(0))).alias(c) for c, bad in KNOWN],
    )
    total = row.select("total").scalar()

    def section(name: str) -> DataFrame:
        own = counts.filter((F.col("section") == name) & label.isNotNull()).orderBy(F.desc("n"), "label")
        own = own.limit(limits[name]) if name in limits else own
        return own.withColumn("percent", share(n, total, 1))

    def line(section: str, label: str, n, percent):
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(label).alias("label"),
            n.cast("bigint").alias("n"),
            percent.cast("double").alias("percent"),
        )

    nothing = F.lit(None)
    facts = [
        line("year", "min", F.col("min_year"), nothing),
        line("year", "max", F.col("max_year"), nothing),
        line("citations", "total", F.col("citations"), round_even(F.col("citations") / F.col("counted"), 2)),
        *[line("quality", c, F.col(c), share(F.col(c), F.col("total"), 1)) for c, _ in KNOWN],
    ]
    parts = [section(name) for name in lists] + [row.select(F.inline(F.array(*facts)))]
    return reduce(DataFrame.unionByName, parts)
