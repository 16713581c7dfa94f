"""Search, point reads, paging and projections over the clean case table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions import text as txt

OTHER, UNCLASSIFIED = "OTHER", "Unclassified"


def _year_bounds(year_from: int | None, year_to: int | None) -> list[Column]:
    """A missing year counts as 0 for the lower and 9999 for the upper bound.

    For any positive lower bound and any upper bound below 9999 that is a plain
    comparison, which reaches the Parquet scan; ``coalesce`` would not.
    """
    year, tests = F.col("year_numeric"), []
    if year_from:
        test = year >= year_from
        tests.append(test if year_from > 0 else test | year.isNull())
    if year_to:
        test = year <= year_to
        tests.append(test if year_to < 9999 else test | year.isNull())
    return tests


def filter_cases(
    df: DataFrame,
    case_type: str | None = None,
    verdict: str | None = None,
    court: str | None = None,
    year_from: int | None = None,
    year_to: int | None = None,
) -> DataFrame:
    """Equality in upper case on the mapped labels, the court as a case-insensitive pattern."""
    tests = _year_bounds(year_from, year_to)
    if case_type:
        tests.append(F.upper("case_type_mapped") == case_type.upper())
    if verdict:
        tests.append(F.upper("verdict_mapped") == verdict.upper())
    if court:
        tests.append(F.col("court").rlike("(?iu)" + court))
    return df.filter(reduce(and_, tests)) if tests else df


def search_cases(df: DataFrame, query: str | None = None, literal: bool = False, **filters) -> DataFrame:
    """``filter_cases`` plus a pattern (or a literal) in the text; a null text never matches."""
    df = filter_cases(df, **filters)
    if not query:
        return df
    if literal:
        return df.filter(F.lower("case_text").contains(query.lower()))
    return df.filter(F.col("case_text").rlike("(?iu)" + query))


def get_case(df: DataFrame, case_id: str) -> DataFrame:
    """The row of one id; the lowest source folder when the id repeats."""
    found = df.filter(F.col("case_id").cast("string") == case_id)
    return found.orderBy("source_folder").limit(1) if "source_folder" in df.columns else found.limit(1)


def drop_empty_text(df: DataFrame, text: str = "case_text") -> DataFrame:
    return df.filter(~txt.is_empty(F.col(text)))


def drop_singleton_classes(df: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Rows of classes with at least *least* rows.

    Counting first and joining the kept labels back moves one row per class; a
    window would sort a dominant class in a single task.
    """
    kept = df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(label)
    return df.join(kept, label, "left_semi")


def known_verdict_rows(df: DataFrame, group: str = "verdict_group") -> DataFrame:
    return df.filter(F.col(group) != "unknown")


def year_between(df: DataFrame, low: int = 1600, high: int = 2100, year: str = "year") -> DataFrame:
    return df.filter(txt.year_number(F.col(year)).between(low, high))


def rows_for_level(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull() & (F.col(label) != OTHER))


def page_of(df: DataFrame, page: int = 1, size: int = 20, key: str = "case_id") -> DataFrame:
    """One page in key order. Spark keeps the first page*size rows per task, then merges."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1, size lies between 1 and 100")
    return df.orderBy(key).offset((page - 1) * size).limit(size)


def page_counts(df: DataFrame, size: int = 20) -> DataFrame:
    """One row: total rows and pages."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.ceil(total / F.lit(size)).cast("bigint").alias("pages"))


def top_by(df: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """The n rows with the largest value; equal values in key order."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(key)).limit(n)


def last_years(yearly: DataFrame, n: int = 20, year: str = "year") -> DataFrame:
    return yearly.orderBy(F.col(year).desc()).limit(n)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows in id order, without the texts; each task keeps n rows, nothing is sorted whole."""
    shown = ("case_id", "year", "court", "case_type", "sub_type", "verdict", "num_citations")
    return df.select(*shown).orderBy("case_id").limit(n)


def case_base(df: DataFrame) -> DataFrame:
    """List view: ids and labels as text, counts as integers, unreadable values as null."""
    texts = (
        "case_id", "case_name", "year", "court", "case_type", "sub_type", "verdict",
        "case_type_mapped", "sub_type_mapped", "verdict_mapped",
    )
    counts = ("num_citations", "text_length", "word_count")
    return df.select(*_casts(df, texts, "string"), *_casts(df, counts, "int"))


def case_detail(df: DataFrame) -> DataFrame:
    base = case_base(df).columns
    extra = [
        *_casts(df, ("case_text", "legal_citations", "source_folder"), "string"),
        *_casts(df, ("year_numeric",), "double"),
    ]
    return df.select(
        *_casts(df, base[:10], "string"), *_casts(df, base[10:], "int"), *extra
    )


def _casts(df: DataFrame, names, kind: str) -> list[Column]:
    """The named columns in *kind*; columns the table lacks are null."""
    return [
        (F.col(n).try_cast(kind) if n in df.columns else F.lit(None).cast(kind)).alias(n) for n in names
    ]


def first_per_group(df: DataFrame, group: str, order: str, n: int = 1) -> DataFrame:
    """First n rows of each group; Spark cuts each task to n rows per group before the exchange."""
    w = W.partitionBy(group).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
