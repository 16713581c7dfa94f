"""Registered queries: filters, paging, joins, aggregates, set operations, balance and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.operators import balance, filters, paging, profile, quality, trends
from casework.functions import citations as cites
from casework.plans.case_table import clean_cases, label_cases, split_clean_unknown
from casework.rules import labels
from casework.rules import label_maps as maps
from casework.rules import outcome_packs as outcomes
from casework.rules.verdict_pack import UNKNOWN_VERDICT
from casework.streaming.resume import Ledger
from casework.session import cut_lineage, scratch_path
from checks import bindings as b
from checks import rule_sql as rs
from checks.bindings import lit, pct, r_even
from checks.registry import register

OC, CLEANED, CASES, LABELLED = b.ORDER_CASES, rs.CLEANED, b.CASES, rs.LABELLED

# -- filters --------------------------------------------------------------------


@register(
    "filter_cases",
    f"""WITH {OC} SELECT case_id, year_numeric, court FROM oc
WHERE upper(case_type_mapped) = '1-URGENT' AND upper(verdict_mapped) = 'F'
  AND regexp_matches(court, '(?i)court 1[0-5]?$') AND coalesce(year_numeric, 0) >= 1996 AND coalesce(year_numeric, 9999) <= 1999""",
)
def _(spark, sf):
    found = filters.filter_cases(b.order_cases(spark, sf), "1-urgent", "f", "COURT 1[0-5]?$", 1996, 1999)
    return found.select("case_id", "year_numeric", "court")


@register(
    "search_cases",
    f"""WITH {CLEANED} SELECT case_id, sub_type FROM known WHERE regexp_matches(case_text, '(?i)slander(ous)?|LARCENY')
  AND coalesce(year_numeric, 0) >= 1855 AND upper(case_type_mapped) IN ('TORTS')""",
)
def _(spark, sf):
    clean = b.cleaned(spark, sf).filter("is_clean")
    return filters.search_cases(clean, "slander(ous)?|larceny", case_type="torts", year_from=1855).select("case_id", "sub_type")


@register(
    "search_cases_literal",
    f"WITH {CASES} SELECT case_id FROM cases WHERE contains(lower(case_text), 'habeas corpus.')",
)
def _(spark, sf):
    return filters.search_cases(b.cases(spark, sf), "Habeas Corpus.", literal=True).select("case_id")


@register(
    "search_cases_pattern",
    f"""WITH {CLEANED} SELECT case_id, sub_type FROM cleaned
WHERE regexp_matches(case_text, '(?i)GRAND\\s+larceny|promissory note|slander(ous)?\\b') AND coalesce(year_numeric, 9999) <= 1875""",
)
def _(spark, sf):
    """A pattern that some texts hold, within years."""
    found = filters.search_cases(b.cleaned(spark, sf), r"GRAND\s+larceny|promissory note|slander(ous)?\b", year_to=1875)
    return found.select("case_id", "sub_type")


@register("get_case", f"WITH {LABELLED} SELECT case_id, case_type, verdict, legal_citations FROM labelled WHERE case_id = '48'")
def _(spark, sf):
    return filters.get_case(b.labelled(spark, sf), "48").select("case_id", "case_type", "verdict", "legal_citations")


@register("drop_empty_text", f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {b.collapse('text')} <> ''")
def _(spark, sf):
    return filters.drop_empty_text(b.documents(spark, sf), "text").select("doc_id")


@register(
    "drop_blank_text",
    f"""WITH d AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || chr(10) || chr(9) ELSE text END AS text FROM documents)
SELECT doc_id FROM d WHERE text IS NOT NULL AND {b.collapse('text')} <> ''""",
)
def _(spark, sf):
    """Missing, empty and blank texts among the documents."""
    kind = F.col("doc_id") % 9
    text = F.when(kind == 0, F.lit(None)).when(kind == 1, "").when(kind == 2, " \n\t").otherwise(F.col("text"))
    return filters.drop_empty_text(b.documents(spark, sf).withColumn("text", text), "text").select("doc_id")


@register(
    "split_clean_unknown",
    f"""WITH {CLEANED} SELECT case_id, CASE WHEN case_type_mapped <> 'Unclassified' AND verdict_mapped <> 'OTHER'
  THEN 'clean' ELSE 'unknown' END AS part FROM cleaned""",
)
def _(spark, sf):
    clean, unknown = split_clean_unknown(b.cleaned(spark, sf).select("case_id", "is_clean"))
    return profile.clean_and_unknown(clean, unknown)


@register(
    "drop_singleton_classes",
    f"WITH {LABELLED} SELECT case_id, verdict FROM labelled WHERE verdict IN (SELECT verdict FROM labelled GROUP BY 1 HAVING count(*) >= 2)",
)
def _(spark, sf):
    df = labels.with_verdict(b.cases(spark, sf), "case_text").select("case_id", "verdict")
    return filters.drop_singleton_classes(df, "verdict")


@register(
    "drop_singleton_customer_years",
    """WITH o AS (SELECT o_orderkey, o_custkey || '/' || year(o_orderdate) AS label FROM orders)
SELECT o_orderkey, label FROM o WHERE label IN (SELECT label FROM o GROUP BY 1 HAVING count(*) >= 2)""",
)
def _(spark, sf):
    """Classes of one customer and year, many of which hold a single order."""
    label = F.concat_ws("/", F.col("o_custkey").cast("string"), F.year("o_orderdate").cast("string"))
    df = b.table(spark, sf, "orders").select("o_orderkey", label.alias("label"))
    return filters.drop_singleton_classes(df, "label")


@register(
    "known_verdict_rows",
    f"WITH {LABELLED} SELECT case_id FROM labelled WHERE {rs.pattern_sql('lower(verdict)', outcomes.VERDICT_GROUPS, 'unknown')} <> 'unknown'",
)
def _(spark, sf):
    df = labels.with_verdict(b.cases(spark, sf), "case_text")
    df = df.withColumn("verdict_group", labels.verdict_group(F.col("verdict")))
    return filters.known_verdict_rows(df).select("case_id")


@register("year_between", f"WITH {CASES} SELECT case_id, year FROM cases WHERE try_cast(year AS INT) BETWEEN 1860 AND 1875")
def _(spark, sf):
    return filters.year_between(b.cases(spark, sf).select("case_id", "year"), 1860, 1875)


@register(
    "rows_for_level",
    f"WITH {rs.TYPED} SELECT case_id FROM typed WHERE {rs.map_sql('sub_type', maps.LEVEL_2_CIVIL)} IS NOT NULL",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), "case_text"), "case_text")
    df = df.withColumn("l2_civil", labels.hierarchy_labels(F.col("sub_type"))["l2_civil"])
    return filters.rows_for_level(df, "l2_civil").select("case_id")


# -- order and paging -------------------------------------------------------------


@register(
    "page_of_cases",
    f"WITH {OC} SELECT case_id, court FROM oc WHERE verdict_mapped = 'O' ORDER BY case_id LIMIT 20 OFFSET 40",
)
def _(spark, sf):
    found = filters.filter_cases(b.order_cases(spark, sf), verdict="o")
    return filters.page_of(found, 3, 20).select("case_id", "court")


@register(
    "page_counts",
    f"WITH {OC} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM oc WHERE verdict_mapped = 'O'",
)
def _(spark, sf):
    return filters.page_counts(filters.filter_cases(b.order_cases(spark, sf), verdict="o"), 20)


def _paged(spark, sf):
    path = scratch_path(spark, "pages")
    paging.write_page_table(b.order_cases(spark, sf), path, "case_id", range_rows=1000)
    return path


@register(
    "deep_page",
    f"WITH {OC} SELECT case_id, court FROM oc ORDER BY case_id LIMIT 20 OFFSET (SELECT count(*) // 40 * 20 - 20 FROM oc)",
)
def _(spark, sf):
    """The page half way through a page table of all orders."""
    path = _paged(spark, sf)
    half = paging.page_totals(spark, path).select(F.floor(F.col("total") / 40).alias("page")).first().page
    return paging.read_page(spark, path, half, 20).select("case_id", "court")


@register("page_table_totals", f"WITH {OC} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM oc")
def _(spark, sf):
    return paging.page_totals(spark, _paged(spark, sf))


@register("page_after", f"WITH {OC} SELECT case_id, court FROM oc WHERE case_id > '48' ORDER BY case_id LIMIT 20")
def _(spark, sf):
    return paging.page_after(b.order_cases(spark, sf), "48", 20).select("case_id", "court")


@register(
    "top_cited",
    f"WITH {LABELLED} SELECT case_id, num_citations FROM labelled ORDER BY num_citations DESC, case_id LIMIT 10",
)
def _(spark, sf):
    return filters.top_by(b.cited(spark, sf).select("case_id", "num_citations"), "num_citations", "case_id", 10)


@register(
    "last_years",
    f"WITH {CASES} SELECT CAST(year AS INT) AS year, count(*) AS n_cases FROM cases WHERE year <> 'Unknown' GROUP BY 1 ORDER BY 1 DESC LIMIT 20",
)
def _(spark, sf):
    df = b.cases(spark, sf).select(F.col("year").try_cast("int").alias("year_numeric"))
    return filters.last_years(profile.annual_volume(df), 20)


@register(
    "preview",
    f"WITH {LABELLED} SELECT case_id, year, court, case_type, sub_type, verdict, num_citations FROM labelled ORDER BY case_id LIMIT 5",
)
def _(spark, sf):
    return filters.preview(b.labelled(spark, sf), 5)


# -- joins ------------------------------------------------------------------------


@register(
    "lookup_with_default",
    "SELECT o_orderkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN n_name END, 'OTHER') AS nation FROM orders "
    "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def _(spark, sf):
    customers = b.table(spark, sf, "customer").filter("c_custkey % 3 > 0")
    named = customers.join(b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    table = named.select(F.col("c_custkey").alias("o_custkey"), "n_name")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return labels.lookup_join(orders, table, "o_custkey", "n_name", "nation", "OTHER").select("o_orderkey", "nation")


@register("remaining_cases", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    ledger.mark_done(b.table(spark, sf, "labels"), "doc_id")
    return ledger.remaining(b.table(spark, sf, "documents").select("doc_id"), "doc_id")


# -- aggregates ---------------------------------------------------------------------


@register(
    "value_counts",
    f"WITH {LABELLED} SELECT verdict AS label, count(*) AS n FROM labelled GROUP BY 1 ORDER BY n DESC, label LIMIT 15",
)
def _(spark, sf):
    return profile.value_counts(labels.with_verdict(b.cases(spark, sf), "case_text"), "verdict", 15)


@register(
    "distribution",
    f"""WITH {OC}, c AS (SELECT court AS label, count(*) AS n FROM oc GROUP BY 1)
SELECT label, n, {pct('n', '(SELECT sum(n) FROM c)')} AS percent FROM c ORDER BY n DESC, label LIMIT 8""",
)
def _(spark, sf):
    return profile.distribution(b.order_cases(spark, sf), "court", 8)


def _listed(col: str, n: int) -> str:
    entry = """'{"label":"' || label || '","n":' || n || ',"percent":' || percent || '}'"""
    return (
        f"(SELECT '[' || coalesce(string_agg({entry}, ',' ORDER BY n DESC, label), '') || ']' FROM (SELECT {col} AS label, count(*) AS n, "
        f"{pct('count(*)', f'(SELECT count({col}) FROM known)')} AS percent FROM known WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY n DESC, label LIMIT {n}) t)"
    )


@register(
    "corpus_stats",
    f"""WITH {CLEANED} SELECT (SELECT count(*) FROM cleaned) AS total_cases, count(*) AS clean_cases,
  (SELECT count(*) FROM cleaned) - count(*) AS unknown_cases, {r_even('avg(num_citations)', 2)} AS avg_citations,
  min(year_numeric) AS min_year, max(year_numeric) AS max_year, {_listed('case_type_mapped', 10)} AS case_type_dist,
  {_listed('verdict_mapped', 10)} AS verdict_dist, {_listed('court', 8)} AS top_courts FROM known""",
)
def _(spark, sf):
    """The three label lists as JSON, because SQL engines hand nested values over in different ways."""
    stats = profile.corpus_stats(b.cleaned(spark, sf))
    return stats.withColumns({c: F.to_json(c) for c in profile.LIST_COLUMNS.values()})


def _dist(name: str, col: str, n: int) -> str:
    return (
        f"(SELECT '{name}' AS list, {col} AS label, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM known)')} AS percent "
        f"FROM known GROUP BY {col} ORDER BY n DESC, label LIMIT {n})"
    )


@register(
    "corpus_distributions",
    f"WITH {CLEANED} " + " UNION ALL ".join([_dist("case_type", "case_type_mapped", 10), _dist("verdict", "verdict_mapped", 10), _dist("court", "court", 8)]),
)
def _(spark, sf):
    # three lists from one labelled table: keep the labels, not the texts
    small = b.cleaned(spark, sf).select("is_clean", "case_type_mapped", "verdict_mapped", "court")
    return profile.corpus_distributions(small)


def yearly_sql(source: str) -> str:
    return f"""SELECT y.*, t.case_type_mapped AS top_case_type, v.verdict_mapped AS top_verdict FROM (
  SELECT year_numeric AS year, count(*) AS n_cases, {r_even('avg(num_citations)', 2)} AS avg_citations,
    CAST(sum(num_citations) AS BIGINT) AS total_citations FROM {source} WHERE year_numeric IS NOT NULL GROUP BY 1) y
JOIN (SELECT year_numeric, case_type_mapped, row_number() OVER (PARTITION BY year_numeric ORDER BY count(*) DESC, case_type_mapped) AS r
  FROM {source} GROUP BY 1, 2) t ON t.year_numeric = y.year AND t.r = 1
JOIN (SELECT year_numeric, verdict_mapped, row_number() OVER (PARTITION BY year_numeric ORDER BY count(*) DESC, verdict_mapped) AS r
  FROM {source} GROUP BY 1, 2) v ON v.year_numeric = y.year AND v.r = 1"""


@register("yearly_statistics", f"WITH {CLEANED} {yearly_sql('cleaned')}")
def yearly_statistics(spark, sf):
    """Labels of whole texts, but only those that are counted; no text leaves its task."""
    wanted = ("case_type", "verdict", "num_citations")
    return profile.yearly_statistics(clean_cases(label_cases(b.cases(spark, sf), columns=wanted)))


@register("yearly_statistics_orders", f"WITH {OC} {yearly_sql('oc')}")
def _(spark, sf):
    return profile.yearly_statistics(b.order_cases(spark, sf))


@register(
    "citation_growth",
    f"""WITH {OC} SELECT year_numeric AS year, {r_even('avg(num_citations)', 6)} AS avg_citations,
  CAST(sum(num_citations) AS BIGINT) AS total_citations, count(num_citations) AS n_cases FROM oc GROUP BY 1""",
)
def _(spark, sf):
    return profile.citation_growth(b.order_cases(spark, sf))


@register("annual_volume", f"WITH {OC} SELECT year_numeric AS year, count(*) AS n_cases FROM oc WHERE year_numeric IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return profile.annual_volume(b.order_cases(spark, sf))


@register(
    "type_subtype_counts",
    f"""WITH {rs.TYPED}, c AS (SELECT case_type AS parent, sub_type AS child, count(*) AS n FROM typed GROUP BY 1, 2),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY parent) AS BIGINT) AS parent_n FROM c)
SELECT parent, child, n, parent_n, {pct('n', 'parent_n')} AS percent FROM p""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), "case_text"), "case_text")
    return profile.type_subtype_counts(df, "case_type", "sub_type")


@register(
    "crosstab",
    f"""WITH {OC} SELECT CASE WHEN grouping(case_type_mapped) = 1 THEN 'All' ELSE case_type_mapped END AS a,
  CASE WHEN grouping(verdict_mapped) = 1 THEN 'All' ELSE verdict_mapped END AS b, count(*) AS n
FROM oc WHERE case_type_mapped IS NOT NULL AND verdict_mapped IS NOT NULL GROUP BY CUBE (case_type_mapped, verdict_mapped)""",
)
def _(spark, sf):
    return profile.crosstab(b.order_cases(spark, sf), "case_type_mapped", "verdict_mapped")


@register(
    "crosstab_wide",
    "SELECT l_returnflag AS a, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    return profile.crosstab_wide(b.table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@register(
    "overview",
    f"""WITH {LABELLED}, o AS (SELECT *, CAST(length(case_text) AS INT) AS text_length FROM labelled)
SELECT count(*) AS total_cases, count(DISTINCT source_folder) AS sources, count(DISTINCT court) AS courts,
  min(try_cast(year AS INT)) AS min_year, max(try_cast(year AS INT)) AS max_year, {r_even('avg(text_length)', 2)} AS avg_length,
  max(text_length) AS max_length, min(text_length) AS min_length, CAST(sum(num_citations) AS BIGINT) AS total_citations,
  {r_even('avg(num_citations)', 2)} AS avg_citations, count(*) FILTER (num_citations > 0) AS cases_with_citations,
  {pct('count(*) FILTER (num_citations > 0)', 'count(*)', 1)} AS cited_percent FROM o""",
)
def _(spark, sf):
    return profile.overview(b.cited(spark, sf).withColumn("text_length", F.length("case_text")))


def describe_sql(col: str, source: str) -> str:
    q = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    stats = {
        "count": f"CAST(count({col}) AS DOUBLE)",
        "mean": f"avg({col})",
        "std": f"stddev_samp({col})",
        "min": f"CAST(min({col}) AS DOUBLE)",
        "max": f"CAST(max({col}) AS DOUBLE)",
        **{n: f"quantile_cont(CAST({col} AS DOUBLE), {p})" for n, p in q.items()},
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS statistic, {r_even(e, 6)} AS value FROM {source}" for n, e in stats.items())


@register("describe_prices", describe_sql("l_extendedprice", "lineitem"))
def _(spark, sf):
    return profile.describe(b.table(spark, sf, "lineitem"), "l_extendedprice")


@register("describe_citations", f"WITH {LABELLED} {describe_sql('num_citations', 'labelled')}")
def _(spark, sf):
    # counts found in whole texts, which the quartiles read several times: kept as one narrow column
    return profile.describe(cut_lineage(b.cited(spark, sf).select("num_citations"), "counts"), "num_citations")


@register(
    "null_counts",
    f"""WITH {OC} SELECT 'num_citations' AS "column", count(*) - count(num_citations) AS nulls FROM oc
UNION ALL SELECT 'court', count(*) - count(court) FROM oc UNION ALL SELECT 'year_numeric', count(*) - count(year_numeric) FROM oc""",
)
def _(spark, sf):
    return profile.null_counts(b.order_cases(spark, sf).select("num_citations", "court", "year_numeric"))


@register("duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents")
def _(spark, sf):
    return profile.duplicate_rows(b.documents(spark, sf).select("text", "lang"))


@register(
    "column_info",
    f"""WITH {OC} SELECT 'num_citations' AS "column", 'int' AS type, count(num_citations) AS non_null FROM oc
UNION ALL SELECT 'court', 'string', count(court) FROM oc""",
)
def _(spark, sf):
    return profile.column_info(b.order_cases(spark, sf).select("num_citations", "court"))


@register(
    "citation_corpus_stats",
    f"""WITH {CASES}, l AS (SELECT list_transform({rs.citation_sql('case_text')}, lambda x: lower(x)) AS cl FROM cases),
c AS (SELECT unnest(cl) AS c FROM l), d AS (SELECT cl, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS total_citations, count(DISTINCT c) AS unique_citations,
  {r_even('1 - count(DISTINCT c) / count(*)', 4)} AS duplicate_ratio,
  (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) FROM d) AS duplicate_lists,
  CAST(0 AS BIGINT) AS rows_with_inner_duplicates FROM c""",
)
def _(spark, sf):
    df = b.cited(spark, sf).select(cites.parse_citation_list(F.array_join("citations", ";")).alias("citation_list"))
    return profile.citation_corpus_stats(df)


@register(
    "mean_citations_by_type",
    f"WITH {LABELLED} SELECT case_type AS label, {r_even('avg(num_citations)', 6)} AS avg_citations FROM labelled GROUP BY 1",
)
def _(spark, sf):
    df = labels.with_case_type(b.cited(spark, sf), "case_text")
    return profile.mean_citations_by(df, "case_type")


_marks = {"affirmed": "AFFIRMED", "reversed": "REVERSED", "set_aside": "SET ASIDE"}


@register(
    "outcome_rates",
    f"WITH {LABELLED} SELECT count(*) AS known, "
    + ", ".join(f"count(*) FILTER (contains(verdict, '{m}')) AS {n}" for n, m in _marks.items())
    + ", "
    + ", ".join(f"{pct(f'''count(*) FILTER (contains(verdict, '{m}'))''', 'count(*)', 1)} AS {n}_percent" for n, m in _marks.items())
    + f" FROM labelled WHERE verdict <> '{UNKNOWN_VERDICT}'",
)
def _(spark, sf):
    return profile.outcome_rates(labels.with_verdict(b.cases(spark, sf), "case_text"))


def _coverage(col: str, bad: str) -> str:
    known = f"count(*) FILTER ({col} IS DISTINCT FROM '{bad}')"
    text = f"format('{{}}/{{}}  ({{:.1f}}%)', {known}, count(*), {pct(known, 'count(*)', 1)})"
    return (
        f"SELECT 'stat' AS level, '{col}_coverage' AS \"check\", {known} AS n, {text} AS detail FROM v "
        f"UNION ALL SELECT 'warning', '{col}_low_coverage', {known}, {text} FROM v HAVING {known} / count(*) * 100 < 70"
    )


@register(
    "validate",
    f"""WITH {LABELLED}, v AS (SELECT * REPLACE (CASE WHEN CAST(case_id AS INT) % 50 = 0 THEN '  ' ELSE case_text END AS case_text,
  CASE WHEN CAST(case_id AS INT) % 60 = 0 THEN '3000' ELSE year END AS year,
  CAST(CAST(case_id AS INT) // 2 AS VARCHAR) AS case_id) FROM labelled)
SELECT 'error' AS level, 'missing_columns' AS "check", CAST(1 AS BIGINT) AS n, 'legal_citations' AS detail
UNION ALL SELECT 'stat', 'total_rows', count(*), '' FROM v
UNION ALL SELECT 'warning', 'empty_text', count(*), '' FROM v WHERE trim(case_text) = '' HAVING count(*) > 0
UNION ALL SELECT 'warning', 'duplicate_ids', count(*) - count(DISTINCT case_id), '' FROM v HAVING count(*) > count(DISTINCT case_id)
UNION ALL SELECT 'warning', 'bad_years', count(*), '' FROM v WHERE try_cast(year AS INT) NOT BETWEEN 1600 AND 2100 HAVING count(*) > 0
UNION ALL {_coverage('verdict', UNKNOWN_VERDICT)}
UNION ALL {_coverage('case_type', 'Unclassified')}
UNION ALL {_coverage('sub_type', 'Unclassified')}
UNION ALL SELECT 'stat', 'year_range', CAST(0 AS BIGINT), min(try_cast(year AS INT)) || ' - ' || max(try_cast(year AS INT)) FROM v""",
)
def _(spark, sf):
    key = F.col("case_id").cast("int")
    df = b.labelled(spark, sf).drop("legal_citations", "citations")
    df = df.withColumns(
        {
            "case_text": F.when(key % 50 == 0, "  ").otherwise(F.col("case_text")),
            "year": F.when(key % 60 == 0, "3000").otherwise(F.col("year")),
            "case_id": F.floor(key / 2).cast("string"),
        }
    )
    return quality.validate(df)


def _section(name: str, col: str, n: str) -> str:
    return (
        f"(SELECT '{name}' AS section, {col} AS label, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM labelled)', 1)} AS percent "
        f"FROM labelled GROUP BY {col} ORDER BY n DESC, label {n})"
    )


def _known(col: str, bad: str) -> str:
    k = f"count(*) FILTER ({col} <> '{bad}')"
    return f"SELECT 'quality', '{col}', {k}, {pct(k, 'count(*)', 1)} FROM labelled"


@register(
    "etl_summary",
    f"""WITH {LABELLED} {_section('source', 'source_folder', '')} UNION ALL {_section('case_type', 'case_type', 'LIMIT 10')}
UNION ALL {_section('sub_type', 'sub_type', 'LIMIT 15')} UNION ALL {_section('verdict', 'verdict', 'LIMIT 10')}
UNION ALL SELECT 'year', 'min', CAST(min(try_cast(year AS INT)) AS BIGINT), NULL FROM labelled
UNION ALL SELECT 'year', 'max', CAST(max(try_cast(year AS INT)) AS BIGINT), NULL FROM labelled
UNION ALL SELECT 'citations', 'total', CAST(sum(num_citations) AS BIGINT), {r_even('avg(num_citations)', 2)} FROM labelled
UNION ALL {_known('verdict', UNKNOWN_VERDICT)} UNION ALL {_known('case_type', 'Unclassified')} UNION ALL {_known('sub_type', 'Unclassified')}""",
)
def _(spark, sf):
    small = b.labelled(spark, sf).select("source_folder", "case_type", "sub_type", "verdict", "year", "num_citations")
    return quality.etl_summary(small)


@register(
    "histogram",
    f"""WITH {CASES}, v AS (SELECT CAST(length(case_text) AS DOUBLE) AS v FROM cases), r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM v)
SELECT CAST(i AS INT) AS bin, {r_even('(SELECT lo FROM r) + i * (SELECT w FROM r)', 6)} AS start,
  (SELECT count(*) FROM v, r WHERE least(floor((v - lo) / w), 49) = i) AS n, {r_even('(SELECT avg(v) FROM v)', 4)} AS mean FROM range(50) t(i)""",
)
def _(spark, sf):
    return profile.histogram(b.cases(spark, sf).select(F.length("case_text").alias("text_length")), "text_length", 50)


@register(
    "histogram_citations",
    f"""WITH {OC}, v AS (SELECT CAST(coalesce(num_citations, 0) AS DOUBLE) AS v FROM oc), r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 40 AS w FROM v)
SELECT CAST(i AS INT) AS bin, {r_even('(SELECT lo FROM r) + i * (SELECT w FROM r)', 6)} AS start,
  (SELECT count(*) FROM v, r WHERE least(floor((v - lo) / w), 39) = i) AS n, {r_even('(SELECT avg(v) FROM v)', 4)} AS mean FROM range(40) t(i)""",
)
def _(spark, sf):
    return profile.histogram(b.order_cases(spark, sf), "num_citations", 40)


# -- set operations -------------------------------------------------------------------


@register(
    "missing_classes",
    "SELECT p_type AS label FROM part EXCEPT SELECT p_type FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_quantity > 45 AND l_linenumber = 6",
)
def _(spark, sf):
    parts = b.table(spark, sf, "part").withColumn("label", F.col("p_type"))
    sold = b.table(spark, sf, "lineitem").filter("l_quantity > 45 AND l_linenumber = 6").select(F.col("l_partkey").alias("p_partkey"))
    return profile.missing_classes(parts, parts.join(sold, "p_partkey", "left_semi"), "label")


@register(
    "open_classes",
    """SELECT o_custkey || ' ' || o_orderpriority AS label FROM orders
EXCEPT SELECT o_custkey || ' ' || o_orderpriority FROM orders WHERE o_orderstatus = 'F'""",
)
def _(spark, sf):
    """Pairs of customer and priority, and those among them without a finished order."""
    label = F.concat_ws(" ", F.col("o_custkey").cast("string"), "o_orderpriority")
    orders = b.table(spark, sf, "orders").withColumn("label", label)
    return profile.missing_classes(orders, orders.filter("o_orderstatus = 'F'"), "label")


# -- balance ----------------------------------------------------------------------------


def _class_sql(col: str, source: str) -> str:
    return f"c AS (SELECT coalesce({col}, 'Unknown') AS label, count(*) AS n FROM {source} GROUP BY 1)"


@register(
    "class_shares",
    f"WITH {OC}, {_class_sql('court', 'oc')} SELECT label, n, {r_even('n / (SELECT sum(n) FROM c)', 6)} AS share FROM c",
)
def _(spark, sf):
    return balance.class_shares(b.order_cases(spark, sf), "court")


@register(
    "balance_report",
    f"""WITH {LABELLED}, {_class_sql('sub_type', 'labelled')}, m AS (
  SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS total, max(n) AS max_n, min(n) AS min_n,
    (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority, (SELECT label FROM c ORDER BY n, label LIMIT 1) AS minority FROM c)
SELECT classes, total, max_n, min_n, majority, minority, {r_even('max_n / min_n', 4)} AS ratio,
  max_n / min_n > 5 AS imbalanced, max_n / min_n > 20 AS severely_imbalanced,
  CASE WHEN max_n / min_n <= 5 THEN 1 WHEN max_n / min_n > 20 THEN 5 ELSE 3 END AS lines FROM m""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), "case_text"), "case_text")
    return balance.balance_report(df, "sub_type").withColumn("lines", F.size("advice")).drop("advice")


def _advice_sql(counts: str) -> str:
    general = "'judge by macro F1, not accuracy', 'split train, validation and test by class'"
    weights = "'use balanced class weights (ratio ' || format('{:.1f}', max_n / min_n) || 'x)'"
    merge = "'minority class ' || chr(39) || minority || chr(39) || ' has only ' || min_n || ' rows: merge rare classes'"
    return f"""SELECT unnest(CASE WHEN max_n / min_n <= 5 THEN ['no special strategy needed']
  WHEN max_n / min_n > 20 THEN [{weights}, {merge}, 'oversample minority classes or undersample the majority class', {general}]
  ELSE [{weights}, {general}] END) AS line
FROM (SELECT max(n) AS max_n, min(n) AS min_n, (SELECT label FROM {counts} ORDER BY n, label LIMIT 1) AS minority FROM {counts})"""


@register(
    "balance_advice",
    f"""WITH {OC}, {LABELLED}, types AS (SELECT case_type AS label, count(*) AS n FROM labelled GROUP BY 1),
subs AS (SELECT sub_type AS label, count(*) AS n FROM labelled GROUP BY 1),
states AS (SELECT verdict_mapped AS label, count(*) AS n FROM oc GROUP BY 1)
SELECT 'case type' AS target, line FROM ({_advice_sql('types')})
UNION ALL SELECT 'sub type', line FROM ({_advice_sql('subs')})
UNION ALL SELECT 'order status', line FROM ({_advice_sql('states')})""",
)
def _(spark, sf):
    """Every line of advice for three columns of different balance."""
    df = label_cases(b.cases(spark, sf), columns=("case_type", "sub_type")).select("case_type", "sub_type")
    reports = {
        "case type": balance.balance_report(df, "case_type"),
        "sub type": balance.balance_report(df, "sub_type"),
        "order status": balance.balance_report(b.order_cases(spark, sf), "verdict_mapped"),
    }
    lines = [r.select(F.lit(name).alias("target"), F.explode("advice").alias("line")) for name, r in reports.items()]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


@register(
    "class_weights",
    f"WITH {OC}, {_class_sql('verdict_mapped', 'oc')} SELECT label, {r_even('1 / n / (SELECT avg(1 / n) FROM c)', 6)} AS weight FROM c",
)
def _(spark, sf):
    return balance.class_weights(b.order_cases(spark, sf), "verdict_mapped")


def _flag(p: str, ok: int) -> str:
    return f"CASE WHEN {p} >= {ok} THEN 'OK' WHEN {p} >= 5 THEN 'MODERATE' ELSE 'MINORITY' END"


@register(
    "balance_tree",
    f"""WITH {rs.TYPED}, c AS (SELECT case_type AS parent, sub_type AS child, count(*) AS n FROM typed GROUP BY 1, 2),
p AS (SELECT *, CAST(sum(n) OVER (PARTITION BY parent) AS BIGINT) AS parent_n, sum(n) OVER () AS total FROM c),
q AS (SELECT *, {pct('parent_n', 'total', 1)} AS parent_percent, {pct('n', 'parent_n', 1)} AS percent FROM p)
SELECT parent, child, n, parent_n, parent_percent, percent, {_flag('parent_percent', 10)} AS parent_flag, {_flag('percent', 15)} AS flag,
  parent_percent > 25 AS dominant, percent > 75 AS overweight, {r_even('max(parent_n) OVER () / parent_n', 1)} AS ratio FROM q""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), "case_text"), "case_text")
    return balance.balance_tree(df.select("case_type", "sub_type"), "case_type", "sub_type")


@register(
    "level_imbalance",
    f"""WITH {rs.TYPED}, l AS (SELECT {rs.map_sql('sub_type', maps.LEVEL_0, "'OTHER'")} AS branch, sub_type AS label FROM typed),
c AS (SELECT branch, label, count(*) AS n FROM l GROUP BY 1, 2)
SELECT branch, count(*) AS classes, CAST(sum(n) AS BIGINT) AS total, {r_even('max(n) / min(n)', 1)} AS ratio, count(*) FILTER (n < 30) AS small_classes,
  CASE WHEN max(n) / min(n) > 50 THEN 'SEVERE' WHEN max(n) / min(n) > 10 THEN 'HIGH' ELSE 'OK' END AS severity FROM c GROUP BY 1""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), "case_text"), "case_text")
    df = df.withColumn("l0_label", labels.hierarchy_labels(F.col("sub_type"))["l0_label"])
    return balance.level_imbalance(df.select("l0_label", "sub_type"), "l0_label", "sub_type")


@register(
    "class_list_counts",
    f"""WITH {rs.TYPED} SELECT label, (SELECT count(*) FROM typed WHERE {rs.map_sql('sub_type', maps.LEVEL_0, "'OTHER'")} = label) AS n
FROM (VALUES ('CIVIL'), ('CRIMINAL'), ('CONTRACT'), ('PROPERTY'), ('TORTS'), ('FAMILY')) t(label)""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), "case_text"), "case_text")
    df = df.select(labels.hierarchy_labels(F.col("sub_type"))["l0_label"].alias("l0_label"))
    return balance.class_list_counts(df, "l0_label", ["CIVIL", "CRIMINAL", "CONTRACT", "PROPERTY", "TORTS", "FAMILY"])


# -- trends -----------------------------------------------------------------------------

_TYPES = [*dict.fromkeys(maps.CASE_TYPE_MERGED.values()), "Unclassified"]


@register(
    "case_type_trends",
    f"""WITH {rs.TYPED}, m AS (SELECT try_cast(year AS INT) AS y, {rs.map_sql('case_type', maps.CASE_TYPE_MERGED, "'Unclassified'")} AS l FROM typed)
SELECT y AS year, {', '.join(f'count(*) FILTER (l = {lit(t)}) AS "{t}"' for t in _TYPES)} FROM m WHERE y IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    df = labels.with_case_type(b.cases(spark, sf), "case_text")
    label = labels.map_label(F.col("case_type"), maps.CASE_TYPE_MERGED, "Unclassified")
    df = df.select(F.col("year").try_cast("int").alias("year_numeric"), label.alias("case_type_mapped"))
    return trends.yearly_pivot(df, "case_type_mapped", _TYPES)


@register(
    "subtype_trends",
    f"""WITH {OC}, top AS (SELECT sub_type_mapped AS label FROM oc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
years AS (SELECT DISTINCT year_numeric AS year FROM oc WHERE sub_type_mapped IN (SELECT label FROM top)),
c AS (SELECT year_numeric AS year, sub_type_mapped AS label, count(*) AS n FROM oc GROUP BY 1, 2)
SELECT year, label, coalesce(n, 0) AS n FROM years CROSS JOIN top LEFT JOIN c USING (year, label)""",
)
def _(spark, sf):
    return trends.top_label_trends(b.order_cases(spark, sf), "sub_type_mapped", 10)


@register(
    "verdict_trends",
    f"""WITH {CLEANED} SELECT year_numeric AS year, {', '.join(f'count(*) FILTER (verdict_mapped = {lit(v)}) AS "{v}"' for v in ('AFFIRMED', 'REVERSED', 'DENIED', 'GRANTED', 'OTHER'))}
FROM cleaned WHERE year_numeric IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    return trends.yearly_pivot(b.cleaned(spark, sf), "verdict_mapped", ["AFFIRMED", "REVERSED", "DENIED", "GRANTED", "OTHER"])


def forecast_sql(source: str, by: str) -> str:
    """The two models written out with closed sums; the change path unrolled for five steps."""
    return f"""y AS (SELECT {by}, year_numeric AS year, CAST(count(*) AS DOUBLE) AS y FROM {source} WHERE year_numeric IS NOT NULL GROUP BY ALL),
d AS (SELECT *, y - lag(y) OVER w AS d FROM y WINDOW w AS (PARTITION BY {by} ORDER BY year)),
e AS (SELECT *, lag(d) OVER (PARTITION BY {by} ORDER BY year) AS d1 FROM d),
f AS (SELECT {by}, count(*) AS n, regr_slope(y, year) AS s, regr_intercept(y, year) AS i, regr_slope(d, d1) AS phi, regr_intercept(d, d1) AS c,
  max(year) AS ly, arg_max(y, year) AS lv, arg_max(d, year) AS ld FROM e GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT {by}, sum((y - i - s * year) ** 2) AS lr, sum((d - c - phi * d1) ** 2) AS ar, count(d - c - phi * d1) AS an
  FROM e JOIN f USING ({by}) GROUP BY ALL),
m AS (SELECT *, ln(greatest(lr, 1e-9) / n) + 6 / n AS la, CASE WHEN n >= 10 AND phi IS NOT NULL THEN ln(greatest(ar, 1e-9) / an) + 6 / an END AS aa
  FROM f JOIN g USING ({by})),
u AS (SELECT *, coalesce({r_even('aa', 9)} < {r_even('la', 9)}, false) AS ua,
  c + phi * ld AS d1, c + phi * (c + phi * ld) AS d2, c + phi * (c + phi * (c + phi * ld)) AS d3,
  c + phi * (c + phi * (c + phi * (c + phi * ld))) AS d4, c + phi * (c + phi * (c + phi * (c + phi * (c + phi * ld)))) AS d5 FROM m),
p AS (SELECT *, CASE WHEN ua THEN lv + d1 + CASE WHEN h > 1 THEN d2 ELSE 0 END + CASE WHEN h > 2 THEN d3 ELSE 0 END
    + CASE WHEN h > 3 THEN d4 ELSE 0 END + CASE WHEN h > 4 THEN d5 ELSE 0 END ELSE i + s * (ly + h) END AS v,
  CASE WHEN ua THEN sqrt(ar / (an - 2)) ELSE sqrt(lr / (n - 2)) END AS sg FROM u CROSS JOIN range(1, 6) t(h))
SELECT {by}, CASE WHEN ua THEN 'autoregression' ELSE 'trend' END AS method, CAST(ly + h AS INT) AS year, {r_even('v', 4)} AS forecast,
  {r_even('v - 1.2816 * sg', 4)} AS low, {r_even('v + 1.2816 * sg', 4)} AS high, {r_even('CASE WHEN ua THEN aa ELSE la END', 4)} AS aic FROM p"""


@register("forecast_by_type", f"WITH {OC}, {forecast_sql('oc', 'case_type_mapped, court')}")
def _(spark, sf):
    return trends.forecast_volume(b.order_cases(spark, sf), ["case_type_mapped", "court"])


@register("forecast_by_court", f"WITH {CASES}, n AS (SELECT *, try_cast(year AS INT) AS year_numeric FROM cases), {forecast_sql('n', 'court')}")
def _(spark, sf):
    df = b.cases(spark, sf).select("court", F.col("year").try_cast("int").alias("year_numeric"))
    return trends.forecast_volume(df, ["court"])


@register(
    "timeline",
    f"""WITH {CASES}, n AS (SELECT *, try_cast(year AS INT) AS year_numeric, 'all' AS one FROM cases), {forecast_sql('n', 'one').replace('SELECT one, CASE WHEN ua', ', fc AS (SELECT one, CASE WHEN ua', 1)})
SELECT year, n_cases, 'history' AS type FROM (SELECT year_numeric AS year, count(*) AS n_cases FROM n WHERE year_numeric IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 20)
UNION ALL SELECT year, CAST(round_even(forecast, 0) AS BIGINT), 'forecast' FROM fc""",
)
def _(spark, sf):
    df = b.cases(spark, sf).select(F.col("year").try_cast("int").alias("year_numeric"))
    return trends.timeline(profile.annual_volume(df), trends.forecast_volume(df))
