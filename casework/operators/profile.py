"""Counts, distributions and summaries of the case table.

Ties are always broken by label, so results do not depend on row order.
Each report aggregates first; windows and joins only ever see the small
aggregated frames.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casework.functions.numbers import round_even, share
from casework.functions.text import year_number
from casework.session import cut_lineage


# The label lists of the statistics page as (list, column, labels shown), and their columns in ``corpus_stats``.
LISTS = (("case_type", "case_type_mapped", 10), ("verdict", "verdict_mapped", 10), ("court", "court", 8))
LIST_COLUMNS = {"case_type": "case_type_dist", "verdict": "verdict_dist", "court": "top_courts"}


def counts_of(df: DataFrame, col: str) -> DataFrame:
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("string").alias("label"))
        .agg(F.count("*").alias("n"))
    )


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    ordered = counts_of(df, col).orderBy(F.desc("n"), "label")
    return ordered if n is None else ordered.limit(n)


def distribution(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n most frequent labels with their share of the non-null rows.

    The total is a scalar subquery over the same counts, not a window that would
    gather all labels in one task.
    """
    counts = counts_of(df, col)
    total = counts.agg(F.sum("n").alias("total"))
    return (
        counts.withColumn("percent", share(F.col("n"), total.scalar()))
        .orderBy(F.desc("n"), "label")
        .limit(n)
    )


def corpus_stats(cleaned: DataFrame) -> DataFrame:
    """One row of totals over the clean and the unknown part (flag column ``is_clean``), and the three label
    lists of ``corpus_distributions`` as arrays of (label, n, percent), the most frequent label first."""
    clean = F.col("is_clean")
    year = F.when(clean, F.col("year_numeric"))
    # labels, years and citation numbers only: the totals and the lists read them from one written table
    kept = ["is_clean", "num_citations", "year_numeric", *[col for _, col, _ in LISTS]]
    small = cut_lineage(cleaned.select(*kept), "totals")
    totals = small.agg(
        F.count("*").alias("total_cases"),
        F.count_if(clean).alias("clean_cases"),
        F.count_if(~clean).alias("unknown_cases"),
        round_even(F.coalesce(F.avg(F.when(clean, F.col("num_citations"))), F.lit(0.0)), 2).alias(
            "avg_citations"
        ),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )
    # a list has at most its n labels
    entry = F.struct((-F.col("n")).alias("minus"), "label", "n", "percent")
    lists = corpus_distributions(small).groupBy("list").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    plain = F.transform("entries", lambda e: F.struct(e["label"].alias("label"), e["n"].alias("n"), e["percent"].alias("percent")))
    found = {name: lists.filter(F.col("list") == name).select(plain).scalar() for name, _, _ in LISTS}
    empty = F.array().cast("array<struct<label:string,n:bigint,percent:double>>")
    return totals.select("*", *[F.coalesce(found[name], empty).alias(out) for name, out in LIST_COLUMNS.items()])


def counts_by_section(df: DataFrame, sections: dict[str, Column]) -> DataFrame:
    """(section, label, n) of several columns in one pass over the rows; null labels are counted too."""
    pairs = [F.struct(F.lit(name).alias("section"), c.cast("string").alias("label")) for name, c in sections.items()]
    return (
        df.select(F.inline(F.array(*pairs))).groupBy("section", "label").agg(F.count("*").alias("n"))
    )


def corpus_distributions(cleaned: DataFrame) -> DataFrame:
    """The three label lists of the statistics page, tagged by list."""
    counts = counts_by_section(cleaned.filter("is_clean"), {name: F.col(col) for name, col, _ in LISTS})
    # one row per label: kept, so that the lists and their totals do not read the cases once each
    counts = cut_lineage(counts.filter(F.col("label").isNotNull()), "label-counts")
    parts = []
    for name, _, n in LISTS:
        own = counts.filter(F.col("section") == name)
        total = own.agg(F.sum("n").alias("total"))
        top = own.withColumn("percent", share(F.col("n"), total.scalar())).orderBy(F.desc("n"), "label").limit(n)
        parts.append(top.withColumnRenamed("section", "list"))
    return reduce(DataFrame.unionByName, parts)


def yearly_statistics(
    df: DataFrame,
    year: str = "year_numeric",
    citations: str = "num_citations",
    case_type: str = "case_type_mapped",
    verdict: str = "verdict_mapped",
) -> DataFrame:
    """Per year: cases, citations, and the most frequent type and verdict (smallest on ties)."""
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(F.col(year).cast("int").alias("year"))
        .agg(
            F.count("*").alias("n_cases"),
            round_even(F.avg(citations), 2).alias("avg_citations"),
            F.sum(citations).cast("bigint").alias("total_citations"),
            F.mode(case_type, True).alias("top_case_type"),
            F.mode(verdict, True).alias("top_verdict"),
        )
    )


def citation_growth(df: DataFrame, year: str = "year_numeric", citations: str = "num_citations") -> DataFrame:
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(F.col(year).cast("int").alias("year"))
        .agg(
            round_even(F.avg(citations), 6).alias("avg_citations"),
            F.sum(citations).cast("bigint").alias("total_citations"),
            F.count(citations).alias("n_cases"),
        )
    )


def annual_volume(df: DataFrame, year: str = "year_numeric", *by: str) -> DataFrame:
    return (
        df.filter(F.col(year).isNotNull())
        .groupBy(*by, F.col(year).cast("int").alias("year"))
        .agg(F.count("*").alias("n_cases"))
    )


def type_subtype_counts(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Counts per pair with the parent's total and the pair's share of it."""
    pairs = df.groupBy(F.col(parent).alias("parent"), F.col(child).alias("child")).agg(
        F.count("*").alias("n")
    )
    total = F.sum("n").over(W.partitionBy("parent"))
    return pairs.withColumns({"parent_n": total, "percent": share(F.col("n"), total)})


def crosstab(df: DataFrame, a: str, b: str, margins: bool = True) -> DataFrame:
    """Contingency table in long form; margins carry the label 'All'."""
    df = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    if not margins:
        return df.groupBy("a", "b").agg(F.count("*").alias("n"))
    cells = df.cube("a", "b").agg(F.count("*").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    return cells.select(
        F.when(F.col("ga") == 1, "All").otherwise(F.col("a")).alias("a"),
        F.when(F.col("gb") == 1, "All").otherwise(F.col("b")).alias("b"),
        "n",
    )


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(F.col(a).alias("a")).pivot(b, list(values)).count().na.fill(0)


def overview(df: DataFrame) -> DataFrame:
    year = year_number(F.col("year"))
    cited = F.col("num_citations") > 0
    return df.agg(
        F.count("*").alias("total_cases"),
        F.count_distinct("source_folder").alias("sources"),
        F.count_distinct("court").alias("courts"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
        round_even(F.avg("text_length"), 2).alias("avg_length"),
        F.max("text_length").alias("max_length"),
        F.min("text_length").alias("min_length"),
        F.sum("num_citations").cast("bigint").alias("total_citations"),
        round_even(F.avg("num_citations"), 2).alias("avg_citations"),
        F.count_if(cited).alias("cases_with_citations"),
        share(F.count_if(cited), F.count("*"), 1).alias("cited_percent"),
    )


def _cuts_below(cuts: Column, v: Column, most: int) -> Column:
    """How many of the sorted cuts lie below v, by halving steps (past the end there is nothing below)."""
    steps = [1 << i for i in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: at + F.when(F.coalesce(F.get(cuts, at + step - 1) < v, F.lit(False)), step).otherwise(0),
    )


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], pieces: int = 256) -> DataFrame:
    """(prob, value) with linear interpolation, exact at any size.

    ``percentile`` would keep every distinct value in one task's buffer. Here an
    approximate sketch cuts the value range into pieces, the piece counts say
    which pieces hold the wanted ranks, and only those pieces are read again and
    ranked: per distinct value, so a value filling a third of the rows is one
    row. The driver sees the cuts and the piece counts, *pieces* numbers each.
    """
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    marks = [i / pieces for i in range(1, pieces)]
    cuts = values.agg(F.array_distinct(F.percentile_approx("v", marks, pieces * 4)).alias("c")).first()["c"] or []
    below = _cuts_below(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), F.col("v"), pieces)
    sizes = {r["piece"]: r["count"] for r in values.groupBy(below.alias("piece")).count().collect()}
    total, starts = 0, {}
    for piece in sorted(sizes):
        starts[piece] = total
        total += sizes[piece]
    if not total:
        return df.sparkSession.createDataFrame([(float(p), None) for p in probs], "prob double, value double")

    def place(rank: int) -> tuple[int, int]:
        piece = max(p for p in starts if starts[p] <= rank)
        return piece, rank - starts[piece]

    wanted = [(p, place(int(p * (total - 1))), place(ceil(p * (total - 1))), p * (total - 1) % 1) for p in probs]
    needed = sorted({at[0] for _, low, high, _ in wanted for at in (low, high)})
    inside = F.lit(None).cast("int")
    for piece in needed:
        # plain comparisons with the cuts, which reach the Parquet scan
        over = F.col("v") > cuts[piece - 1] if piece > 0 else F.lit(True)
        within = over & (F.col("v") <= cuts[piece]) if piece < len(cuts) else over
        inside = F.when(within, piece).otherwise(inside)
    runs = values.withColumn("piece", inside).filter("piece IS NOT NULL").groupBy("piece", "v").agg(F.count("*").alias("n"))
    runs = runs.withColumn("last", F.sum("n").over(W.partitionBy("piece").orderBy("v")))

    def value_at(at: tuple[int, int]) -> Column:
        piece, rank = at
        hit = (F.col("piece") == piece) & (F.col("last") > rank) & (F.col("last") - F.col("n") <= rank)
        return F.max(F.when(hit, F.col("v")))

    ends = runs.agg(
        F.array(
            *[
                F.struct(F.lit(float(p)).alias("prob"), value_at(lo).alias("lo"), value_at(hi).alias("hi"), F.lit(part).alias("part"))
                for p, lo, hi, part in wanted
            ]
        ).alias("e")
    )
    return ends.select(F.inline("e")).select(
        "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value")
    )


def describe(df: DataFrame, col: str) -> DataFrame:
    """(statistic, value): count, mean, sample deviation, minimum, quartiles, maximum."""
    c = F.col(col).cast("double")
    simple = df.agg(
        F.count(c).cast("double").alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    )
    stats = simple.unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    quartiles = exact_quantiles(df, col, (0.25, 0.5, 0.75)).select(
        F.format_string("%d%%", (F.col("prob") * 100).cast("int")).alias("statistic"), "value"
    )
    return stats.unionByName(quartiles).withColumn("value", round_even(F.col("value"), 6))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], list(df.columns), "column", "nulls")


def row_digest(df: DataFrame, *columns: str) -> Column:
    """A digest of the row: equal rows meet by 32 bytes instead of by their whole text."""
    return F.sha2(F.to_json(F.struct(*(columns or df.columns))), 256)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier row in full."""
    groups = df.select(row_digest(df).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def column_info(df: DataFrame) -> DataFrame:
    """(column, type, non-null rows)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    filled = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    long = filled.unpivot([], list(df.columns), "column", "non_null")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), F.col("column"))
    return long.withColumn("type", kind)


def citation_corpus_stats(df: DataFrame, citations: str = "citation_list") -> DataFrame:
    """One row over lists of citations: totals, distinct, repeats inside and between rows."""
    # Both halves read the lists, which may have been found in whole texts: find them once.
    df = cut_lineage(df.select(citations), "citation-lists")
    # One exchange of distinct citations with their counts serves both totals.
    each = df.select(F.explode(citations).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    totals = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"))
    lists = (
        df.select(F.sha2(F.to_json(citations), 256).alias("d"),
                  (F.size(citations) != F.size(F.array_distinct(citations))).cast("int").alias("inner"))
        .groupBy("d")
        .agg(F.count("*").alias("n"), F.sum("inner").alias("inner"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_lists"),
            F.coalesce(F.sum("inner"), F.lit(0)).alias("rows_with_inner_duplicates"),
        )
    )
    ratio = 1 - F.col("distinct") / F.col("total")
    return lists.select(
        totals.select("total").scalar().alias("total_citations"),
        totals.select("distinct").scalar().alias("unique_citations"),
        totals.select(round_even(ratio, 4).alias("r")).scalar().alias("duplicate_ratio"),
        "duplicate_lists",
        "rows_with_inner_duplicates",
    )


def mean_citations_by(df: DataFrame, by: str = "case_type") -> DataFrame:
    return (
        df.groupBy(F.col(by).alias("label"))
        .agg(round_even(F.avg("num_citations"), 6).alias("avg_citations"))
        .orderBy(F.desc("avg_citations"), "label")
    )


def outcome_rates(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Shares of AFFIRMED, REVERSED and SET ASIDE (as written) among the known verdicts."""
    known = df.filter(F.col(verdict) != "Verdict Unknown")
    marks = {"affirmed": "AFFIRMED", "reversed": "REVERSED", "set_aside": "SET ASIDE"}
    hits = {name: F.col(verdict).contains(word) for name, word in marks.items()}
    return known.agg(
        F.count("*").alias("known"),
        *[F.count_if(hit).alias(name) for name, hit in hits.items()],
        *[share(F.count_if(hit), F.count("*"), 1).alias(f"{name}_percent") for name, hit in hits.items()],
    )


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; empty bins included.

    Every row carries the mean of all values, which is drawn across the bins.
    """
    spark = df.sparkSession
    values = df.select(F.coalesce(F.col(col).cast("double"), F.lit(0.0)).alias("v"))
    # one pass for the range; the bounds are two numbers, read back as scalar subqueries
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    mean = bounds.select("mean").scalar()
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select(
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    lo, width = bounds.select("lo").scalar(), bounds.select(((F.col("hi") - F.col("lo")) / bins).alias("w")).scalar()
    number = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin",
        round_even(lo + F.col("bin") * width, 6).alias("start"),
        F.coalesce("n", F.lit(0)).alias("n"),
        round_even(mean, 4).alias("mean"),
    )


def missing_classes(expected: DataFrame, present: DataFrame, label: str) -> DataFrame:
    """Expected classes without a row."""
    return expected.select(label).distinct().join(present.select(label).distinct(), label, "left_anti")


def clean_and_unknown(clean: DataFrame, unknown: DataFrame) -> DataFrame:
    return clean.withColumn("part", F.lit("clean")).unionByName(
        unknown.withColumn("part", F.lit("unknown")), allowMissingColumns=True
    )
