"""The rule packs as DataFrame and Column functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.numbers import round_even
from casework.functions.text import SPACES, collapse_spaces
from casework.rules import label_maps as maps
from casework.rules import outcome_packs as outcomes
from casework.rules import type_packs as packs
from casework.rules.engine import Found, contains_any, first_match, keyword_sql, pattern_label, score_sql
from casework.rules.verdict_pack import UNKNOWN_VERDICT, VERDICT_BLOCKS
from casework.session import compute_once

_LOWER, _FOUND, _SCORES = "_type_text", "_type_found", "_type_scores"


def _lowered(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(_LOWER, F.lower(F.coalesce(F.col(text), F.lit(""))))


def with_case_type(df: DataFrame, text: str, out: str = "case_type", early: bool = False) -> DataFrame:
    """Type with the largest keyword score; defamation words decide on their own."""
    weights = packs.EARLY_TYPE_WEIGHTS if early else packs.TYPE_WEIGHTS
    defamation = packs.EARLY_DEFAMATION_WORDS if early else packs.DEFAMATION_WORDS
    found = Found(_FOUND)
    scores = ", ".join(score_sql(_LOWER, entries, found) for entries in weights.values())
    defamed = contains_any(_LOWER, defamation, found)
    df = found.add_to(_lowered(df, text), _LOWER)
    # Scores get their own projection so that the comparison does not evaluate them twice.
    df = df.withColumn(_SCORES, F.expr(f"array({scores})"))
    best = F.array_max(_SCORES)
    winner = F.element_at(
        F.array(*[F.lit(name) for name in weights]), F.array_position(_SCORES, best).cast("int")
    )
    label = (
        F.when(F.expr(defamed), packs.DEFAMATION)
        .when(best == 0, packs.UNCLASSIFIED)
        .otherwise(winner)
    )
    return compute_once(df, {out: label}).drop(_LOWER, _FOUND, _SCORES)


def sub_type_sql(text: str, case_type: str, early: bool = False, found: Found | None = None) -> str:
    """CASE over the types, each with its own ordered keyword list, for a lower-cased column."""
    lists = packs.EARLY_SUB_TYPES if early else packs.SUB_TYPES
    general = packs.EARLY_ANY_TYPE if early else packs.ANY_TYPE
    whens = " ".join(
        f"WHEN '{name}' THEN {keyword_sql(text, *groups, found)}" for name, groups in lists.items()
    )
    return f"CASE {case_type} {whens} ELSE {keyword_sql(text, *general, found)} END"


def with_sub_type(
    df: DataFrame, text: str, case_type: str = "case_type", out: str = "sub_type", early: bool = False
) -> DataFrame:
    """First keyword hit in the list of the row's case type; a general list for other types."""
    found = Found(_FOUND)
    label = sub_type_sql(_LOWER, case_type, early, found)
    df = found.add_to(_lowered(df, text), _LOWER)
    return compute_once(df, {out: F.expr(label)}).drop(_LOWER, _FOUND)


def with_verdict(df: DataFrame, text: str, out: str = "verdict", block_out: str | None = None) -> DataFrame:
    return first_match(df, F.col(text), VERDICT_BLOCKS, out, UNKNOWN_VERDICT, block_out)


def verdict_group(verdict: Column) -> Column:
    lower = F.lower(F.coalesce(verdict, F.lit("")))
    return pattern_label(lower, outcomes.VERDICT_GROUPS, outcomes.UNKNOWN_GROUP)


def clean_ocr(verdict: Column) -> Column:
    """Repair scanning errors, collapse spaces, upper case; blank gives ''."""
    out = collapse_spaces(F.coalesce(verdict, F.lit("")))
    for pattern, replacement in outcomes.SCAN_REPAIRS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.upper(F.trim(F.regexp_replace(out, SPACES, " ")))


def outcome_keyword(cleaned: Column) -> Column:
    return pattern_label(cleaned, outcomes.OUTCOME_KEYWORDS, outcomes.UNKNOWN_KEYWORD)


def map_label(c: Column, mapping: Mapping[str, str], default: str | None = None) -> Column:
    """Dictionary lookup in the projection. For maps of any size use ``lookup_join``.

    An IN-style chain over a few dozen literals needs neither a join nor an exchange.
    """
    by_label: dict[str, list[str]] = {}
    for name, label in mapping.items():
        by_label.setdefault(label, []).append(name)
    found = [F.when(c.isin(*names), F.lit(label)) for label, names in by_label.items()]
    return F.coalesce(*found, F.lit(default))


def lookup_join(
    df: DataFrame, mapping: DataFrame, key: str, value: str, out: str, default: str | None = None
) -> DataFrame:
    """Dictionary lookup as a left join on a (key, value) table; Spark sizes the table itself."""
    table = mapping.select(F.col(key).alias(key), F.col(value).alias(out))
    return df.join(table, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(default)))


def four_class(keyword: Column) -> Column:
    """Class of an outcome keyword; null for a keyword outside the map (see ``unmapped_keywords``)."""
    return map_label(keyword, outcomes.FOUR_CLASS)


def with_four_class(df: DataFrame, verdict: str) -> DataFrame:
    df = df.withColumn("verdict_clean", clean_ocr(F.col(verdict)))
    df = df.withColumn("keyword", outcome_keyword(F.col("verdict_clean")))
    return df.withColumn("four_class_label", four_class(F.col("keyword")))


def unmapped_keywords(df: DataFrame) -> DataFrame:
    """Keywords without a class; anything here is an error in the maps."""
    return df.filter(F.col("four_class_label").isNull()).groupBy("keyword").count()


def verify_rules(cases: DataFrame, verdict: str, expected: str) -> DataFrame:
    """One row: total, passed, accuracy percentage of the four-class rules on labelled forms."""
    ok = (F.col("four_class_label") == F.col(expected)).cast("int")
    return with_four_class(cases, verdict).agg(
        F.count("*").alias("total"),
        F.sum(ok).alias("passed"),
        round_even(F.avg(ok) * 100.0, 1).alias("accuracy"),
    )


def rule_failures(cases: DataFrame, verdict: str, expected: str) -> DataFrame:
    return with_four_class(cases, verdict).filter(~F.col("four_class_label").eqNullSafe(F.col(expected)))


def merge_case_type(c: Column) -> Column:
    return map_label(c, maps.CASE_TYPE_MERGED)


def merge_sub_type(c: Column, scheme: str) -> Column:
    mapping = maps.SUB_TYPE_SCHEMES[scheme]
    if scheme not in maps.LOWER_CASE_SCHEMES:
        return map_label(c, mapping, outcomes.OTHER)
    name = F.lower(F.coalesce(c.cast("string"), F.lit("nan")))
    name = F.trim(name) if scheme == "final" else name
    lowered = map_label(name, mapping, outcomes.OTHER)
    return F.when(name.contains("appeal"), maps.LOWER_CASE_SCHEMES[scheme]).otherwise(lowered)


def hierarchy_labels(sub_type: Column) -> dict[str, Column]:
    return {
        "l0_label": map_label(sub_type, maps.LEVEL_0, outcomes.OTHER),
        "l1_label": map_label(sub_type, maps.LEVEL_1),
        "l2_civil": map_label(sub_type, maps.LEVEL_2_CIVIL),
        "l2_criminal": map_label(sub_type, maps.LEVEL_2_CRIMINAL),
    }


def default_verdict_class(verdict: Column) -> Column:
    return pattern_label(F.lower(F.coalesce(verdict, F.lit(""))), outcomes.VERDICT_CLASSES, outcomes.OTHER)


def with_mapped_labels(
    df: DataFrame,
    case_type: str = "case_type",
    sub_type: str = "sub_type",
    verdict: str = "verdict",
    type_map: Mapping[str, str] | None = None,
    sub_map: Mapping[str, str] | None = None,
    verdict_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """The three mapped label columns, of those labels that *df* has; each map may be the caller's own."""
    sub_labels = {name: f"{group}__{name}" for name, group in maps.LEVEL_0.items()}
    mapped = {
        "case_type_mapped": (case_type, lambda c: map_label(c, type_map or maps.CASE_TYPE_MERGED, packs.UNCLASSIFIED)),
        "sub_type_mapped": (sub_type, lambda c: map_label(c, sub_map or sub_labels, "UNCLASSIFIED__General")),
        "verdict_mapped": (
            verdict,
            lambda c: map_label(c, verdict_map, outcomes.OTHER) if verdict_map else default_verdict_class(c),
        ),
    }
    return df.withColumns({out: label(F.col(c)) for out, (c, label) in mapped.items() if c in df.columns})


def label_leak_rate(df: DataFrame, label: str, text: str) -> DataFrame:
    """Share of each label's rows whose text names the label, the tell-tale of a leaking target."""
    named = F.lower(F.col(text)).contains(F.lower(F.col(label))).cast("int")
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count("*").alias("n"), round_even(F.avg(named), 4).alias("leak_rate")
    )


def check_features(columns: list[str], derived_from_label: list[str]) -> None:
    """Raise when a label-derived column is among the feature columns."""
    leaked = sorted(set(columns) & set(derived_from_label))
    if leaked:
        raise ValueError(f"label-derived columns among the features: {leaked}")


def unmapped_audit(df: DataFrame, raw: str, mapped: str, fallback: str) -> DataFrame:
    """Raw values that fell through to the fallback label, with counts."""
    return (
        df.filter(F.col(mapped) == fallback)
        .groupBy(F.col(raw).alias("value"))
        .agg(F.count("*").alias("n"))
    )
