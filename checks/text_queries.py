"""Registered queries: sources, text functions and rule packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casework.functions import citations as cites
from casework.functions import text as txt
from casework.functions.pages import page_text
from casework.functions.sidecar import parse_sidecar
from casework.operators import filters
from casework.plans.case_table import process_cases
from casework.rules import label_maps as maps
from casework.rules import labels
from casework.rules import outcome_packs as outcomes
from casework.session import spread
from checks import bindings as b
from checks import rule_sql as rs
from checks.bindings import collapse, lit
from checks.registry import SQL, register
from checks.verdict_goldens import VERDICT_TEXTS

# -- pages and sidecars ---------------------------------------------------------


def page_sql(c: str) -> str:
    for tag in ("script", "style", "nav", "footer", "header"):
        c = f"regexp_replace({c}, {lit(rf'(?is)<{tag}\b[^>]*>.*?</{tag}\s*>')}, '', 'g')"
    c = f"regexp_replace({c}, {lit('(?s)<!--.*?-->')}, '', 'g')"
    c = f"regexp_replace({c}, {lit('<[/!?a-zA-Z][^>]*>')}, ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {lit(entity)}, {lit(char)})"
    return c


def clean_sql(c: str) -> str:
    return collapse(f"regexp_replace({c}, {lit(txt.PAGE_MARK)}, '', 'g')")


@register(
    "page_text",
    f"SELECT page_id, CAST(length(raw) AS INT) AS raw_length, {clean_sql('raw')} AS text "
    f"FROM (SELECT page_id, {page_sql('html')} AS raw FROM pages)",
)
def _(spark, sf):
    df = spread(b.table(spark, sf, "pages"), "page_id").withColumn("raw", page_text(F.col("html")))
    return df.select("page_id", F.length("raw").alias("raw_length"), txt.clean_text(F.col("raw")).alias("text"))


_BAD_JSON = "o_orderkey % 11 = 0"
_SIDECARS = f"""side AS (
  SELECT o_orderkey, 'Case ' || o_orderkey || ' v. State' AS name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
    {_BAD_JSON} AS bad, o_orderkey % 3 = 0 AS plain, o_orderkey % 5 = 0 AS bare, 'Court ' || (o_custkey % 7) AS court,
    (o_orderkey % 90) || ' Ind. ' || (o_custkey % 400) AS cite, (o_orderkey % 40) || ' Conn. 7' AS cited
  FROM orders)"""


def _sidecar_json(spark, sf):
    o = b.table(spark, sf, "orders")
    key, court = F.col("o_orderkey"), F.concat(F.lit("Court "), F.col("o_custkey") % 7)
    own = F.format_string('[{"cite":"%d Ind. %d"}]', key % 90, F.col("o_custkey") % 400)
    cited = F.format_string('["7 Ind. 200",{"cite":"%d Conn. 7"},{"other":1}]', key % 40)
    body = F.concat(
        F.format_string('{"name":"Case %d v. State","decision_date":"', key),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('","court":'),
        F.when(key % 3 == 0, F.concat(F.lit('"'), court, F.lit('"'))).otherwise(
            F.concat(F.lit('{"name":"'), court, F.lit('"}'))
        ),
        F.when(key % 5 == 0, "").otherwise(F.concat(F.lit(',"citations":'), own, F.lit(',"cites_to":'), cited)),
        F.lit("}"),
    )
    return o.select("o_orderkey", F.when(key % 11 == 0, F.substring(body, 1, 20)).otherwise(body).alias("json"))


@register(
    "parse_sidecar",
    f"""WITH {_SIDECARS}
SELECT o_orderkey, CASE WHEN bad THEN '' ELSE name END AS name, CASE WHEN bad THEN '' ELSE day END AS decision_date,
  '' AS docket_number, CASE WHEN bad THEN '' ELSE court END AS court_name,
  CASE WHEN bad OR bare THEN '' ELSE cite || '|7 Ind. 200|' || cited END AS cites
FROM side""",
)
def _(spark, sf):
    df = parse_sidecar(_sidecar_json(spark, sf), "json")
    return df.select(
        "o_orderkey", "name", "decision_date", "docket_number", "court_name",
        F.array_join("sidecar_citations", "|").alias("cites"),
    )


_raw = f"""raw AS MATERIALIZED (
  SELECT page_id, stem, page, json_name, day, {clean_sql('page')} AS case_text
  FROM (SELECT page_id, 'src_' || lpad(CAST(page_id AS VARCHAR), 4, '0') AS stem,
          {page_sql(f"html || '<p>' || {b._choose(b.PHRASES, 'page_id')} || '</p>'")} AS page,
          CASE WHEN page_id % 3 = 0 THEN 'Doe v. Roe' ELSE '' END AS json_name,
          CASE WHEN page_id % 2 = 0 THEN '18' || lpad(CAST(page_id % 90 AS VARCHAR), 2, '0') || '-03-01' ELSE '' END AS day
        FROM pages))"""
_windows, _verdict = rs.verdict_sql("t")


@register(
    "process_cases",
    f"""WITH {_raw},
typed AS (SELECT *, {rs.type_sql('t')} AS case_type FROM (SELECT *, lower(case_text) AS t FROM raw)),
full_ AS (SELECT *, {rs.sub_sql('t', 'case_type')} AS sub_type, {_verdict} AS verdict,
            list_sort(list_distinct({rs.citation_sql('case_text')} || ['5 Ind. 9'])) AS citations
          FROM (SELECT *, {_windows} FROM typed))
SELECT lpad(CAST(page_id AS VARCHAR), 4, '0') AS case_id,
  coalesce(nullif(json_name, ''), CASE WHEN regexp_matches(left(case_text, 500), {lit(txt.CAPTION)})
    THEN regexp_extract(left(case_text, 500), {lit(txt.CAPTION)}, 1) || ' v. ' || regexp_extract(left(case_text, 500), {lit(txt.CAPTION)}, 2) END, stem) AS case_name,
  'src' AS source_folder,
  coalesce(nullif(left(day, 4), ''), nullif(regexp_extract(case_text, '\\b((?:18|19|20)\\d{{2}})\\b', 1), ''), 'Unknown') AS year,
  coalesce('Supreme Court of ' || nullif(regexp_extract(case_text, 'Supreme Court of ([A-Za-z]+)', 1), ''), 'Supreme Court of Indiana') AS court,
  case_text, CAST(length(page) AS INT) AS case_text_full_length, verdict, case_type, sub_type,
  CAST(len(citations) AS INT) AS num_citations, array_to_string(citations, '; ') AS legal_citations,
  day AS decision_date, '' AS docket_number, '' AS first_page, '' AS last_page
FROM full_ WHERE case_text <> ''""",
)
def _(spark, sf):
    return process_cases(_raw_cases(spark, sf))


def _raw_cases(spark, sf):
    pages = spread(b.table(spark, sf, "pages"), "page_id")
    key = F.col("page_id")
    name = F.when(key % 3 == 0, "Doe v. Roe").otherwise("")
    day = F.when(key % 2 == 0, F.format_string("18%02d-03-01", key % 90)).otherwise("")
    return pages.select(
        F.lit("src").alias("source"),
        F.format_string("src_%04d", key).alias("stem"),
        F.concat("html", F.lit("<p>"), b._pick(b.PHRASES, "page_id"), F.lit("</p>")).alias("html"),
        F.to_json(
            F.struct(
                name.alias("name"), day.alias("decision_date"), F.array(F.lit("5 Ind. 9")).alias("cites_to")
            )
        ).alias("json"),
    )


@register(
    "process_cases_whole",
    SQL["process_cases"],
)
def _(spark, sf):
    return process_cases(_raw_cases(spark, sf))


# -- scalar text functions ------------------------------------------------------


def _case_query(name: str, columns: dict[str, object], sql: dict[str, str], key: str = "case_id"):
    """A projection over the case view, with one SQL expression per column."""

    @register(name, f"WITH {b.CASES} SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM cases")
    def _(spark, sf):
        return b.cases(spark, sf).select(key, *[c().alias(n) for n, c in columns.items()])


@register("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def _(spark, sf):
    return b.documents(spark, sf).select("doc_id", txt.clean_text(F.col("text")).alias("text"))


T = "case_text"
_case_query(
    "truncate_text",
    {"text": lambda: txt.truncate(F.col(T), 1000)},
    {"text": "CASE WHEN length(case_text) <= 1000 THEN case_text ELSE regexp_replace(left(case_text, 1000), ' [^ ]*$', '') END"},
)
_case_query(
    "stored_text", {"text": lambda: txt.stored_text(F.col(T))}, {"text": "substr(case_text, 1, 10000)"}
)
_case_query(
    "extract_year",
    {"found": lambda: txt.extract_year(F.when(F.col("case_id").cast("int") % 2 == 0, F.concat("year", F.lit("-03-01"))), F.col(T))},
    {
        "found": "coalesce(CASE WHEN CAST(case_id AS INT) % 2 = 0 THEN nullif(regexp_extract(year, '(\\d{4})', 1), '') END, "
        "nullif(regexp_extract(case_text, '\\b((?:18|19|20)\\d{2})\\b', 1), ''), 'Unknown')"
    },
)
_case_query(
    "year_in_text",
    {"found": lambda: txt.year_in_text(F.col(T))},
    {"found": "nullif(regexp_extract(case_text, '\\b(1[7-9]\\d{2}|20\\d{2})\\b', 1), '')"},
)


@register(
    "fix_year",
    """SELECT o_orderkey, CASE WHEN k IN (0, 1, 2) THEN 'Unknown' ELSE regexp_extract(cell, '(1[6-9]\\d{2}|20[0-2]\\d)', 1) END AS year
FROM (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(o_orderdate AS VARCHAR) AS cell FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey") % 7
    cell = F.when(k == 0, "  NaN ").when(k == 1, "#########").when(k == 2, F.lit(None)).otherwise(
        F.concat(F.lit(" "), F.col("o_orderdate").cast("string"))
    )
    return b.table(spark, sf, "orders").select("o_orderkey", txt.fix_year(cell).alias("year"))


_case_query(
    "extract_court",
    {"found": lambda: txt.extract_court(F.when(F.col("case_id").cast("int") % 3 == 0, F.col("court")), F.col(T))},
    {
        "found": "coalesce(CASE WHEN CAST(case_id AS INT) % 3 = 0 THEN court END, "
        "'Supreme Court of ' || nullif(regexp_extract(case_text, 'Supreme Court of ([A-Za-z]+)', 1), ''), 'Supreme Court of Indiana')"
    },
)
_case_query(
    "extract_case_name",
    {"name": lambda: txt.extract_case_name(F.lit(""), F.col(T), F.concat(F.lit("file_"), "case_id"))},
    {
        "name": f"CASE WHEN regexp_matches(left(case_text, 500), {lit(txt.CAPTION)}) THEN regexp_extract(left(case_text, 500), {lit(txt.CAPTION)}, 1)"
        f" || ' v. ' || regexp_extract(left(case_text, 500), {lit(txt.CAPTION)}, 2) ELSE 'file_' || case_id END"
    },
)
_case_query(
    "case_id_from_stem",
    {"stem_id": lambda: txt.case_id_from_stem(F.concat(F.lit("f"), F.col("case_id").cast("int") * 37, F.lit("_x")))},
    {
        "stem_id": "coalesce(nullif(regexp_extract('f' || (CAST(case_id AS INT) * 37) || '_x', '(\\d{4})', 1), ''), "
        "'f' || (CAST(case_id AS INT) * 37) || '_x')"
    },
)
_case_query(
    "dollar_amount",
    {"amount": lambda: txt.first_amount(F.col(T))},
    {"amount": f"nullif(regexp_extract(case_text, {lit(txt.AMOUNT)}, 0), '')"},
)


@register(
    "small_text_helpers",
    f"""SELECT doc_id, CAST(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS INT) AS words, c = '' AS empty,
  CAST(length(text) AS INT) AS text_length, 'doc ' || doc_id AS name
FROM (SELECT doc_id, text, {collapse('text')} AS c FROM documents)""",
)
def _(spark, sf):
    return b.documents(spark, sf).select(
        "doc_id",
        txt.word_count(F.col("text")).alias("words"),
        txt.is_empty(F.col("text")).alias("empty"),
        F.length("text").alias("text_length"),
        txt.clean_case_name(F.concat(F.lit("  doc "), "doc_id", F.lit(" "))).alias("name"),
    )


@register(
    "title_case",
    r"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(text), '\p{L}+|[^\p{L}]+'),
  lambda x: CASE WHEN left(x, 1) = 'ß' THEN 'Ss' ELSE upper(left(x, 1)) END || substr(x, 2)), '') AS title FROM benchmark""",
)
def _(spark, sf):
    return b.table(spark, sf, "benchmark").select("item_id", txt.title_case(F.col("text")).alias("title"))


@register(
    "clean_legal_text",
    f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), {lit(txt.SPACES)}, ' ', 'g'), "
    "'\\p{Nd}+', ' ', 'g'), '[^a-z ]', ' ', 'g')) AS text FROM documents",
)
def _(spark, sf):
    return b.documents(spark, sf).select("doc_id", txt.clean_legal_text(F.col("text")).alias("text"))


_case_query(
    "legal_flags",
    {n: (lambda n=n: txt.legal_flags(F.col(T))[n]) for n in txt.FLAG_PATTERNS},
    {n: f"CAST(regexp_matches(case_text, {lit('(?i)' + p)}) AS INT)" for n, p in txt.FLAG_PATTERNS.items()},
)


# -- citations ------------------------------------------------------------------


@register(
    "extract_citations",
    f"WITH {b.CASES} SELECT case_id, array_to_string(list_sort(list_distinct({rs.citation_sql('case_text')} || ['A Rep. 99'])), '|') AS citations FROM cases",
)
def _(spark, sf):
    found = cites.extract_citations(F.col(T), F.array(F.lit("A Rep. 99"), F.lit("")))
    return b.cases(spark, sf).select("case_id", F.array_join(found, "|").alias("citations"))


@register(
    "citation_columns",
    f"""WITH {b.CASES}, c AS (SELECT case_id, {rs.citation_sql('case_text')} AS l FROM cases)
SELECT case_id, CAST(len(l) AS INT) AS num_citations, array_to_string(l, '; ') AS legal_citations FROM c""",
)
def _(spark, sf):
    return b.cited(spark, sf).select("case_id", "num_citations", "legal_citations")


_CELL = "case_id || ' Ind.  7; ' || legal || ' ;;' || upper(legal)"


@register(
    "parse_citation_list",
    f"""WITH {b.CASES}, c AS (SELECT case_id, array_to_string({rs.citation_sql('case_text')}, ';') AS legal FROM cases),
parts AS (SELECT case_id, unnest(string_split({_CELL}, ';')) AS p, generate_subscripts(string_split({_CELL}, ';'), 1) AS i FROM c),
tidy AS (SELECT case_id, lower({collapse('p')}) AS p, min(i) AS i FROM parts GROUP BY 1, 2),
joined AS (SELECT case_id, CAST(count(*) AS INT) AS n, string_agg(p, '; ' ORDER BY i) AS cleaned FROM tidy WHERE p <> '' GROUP BY 1)
SELECT * FROM joined""",
)
def _(spark, sf):
    df = b.cited(spark, sf).withColumn("legal", F.array_join("citations", ";"))
    cell = F.concat("case_id", F.lit(" Ind.  7; "), "legal", F.lit(" ;;"), F.upper("legal"))
    df = df.withColumn("l", cites.parse_citation_list(cell))
    return df.select("case_id", F.size("l").alias("n"), F.array_join("l", "; ").alias("cleaned"))


# -- rule packs -----------------------------------------------------------------


@register("case_type", f"WITH {rs.TYPED} SELECT case_id, case_type FROM typed")
def _(spark, sf):
    return labels.with_case_type(b.cases(spark, sf), T).select("case_id", "case_type")


@register("sub_type", f"WITH {rs.TYPED} SELECT case_id, sub_type FROM typed")
def _(spark, sf):
    return labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), T), T).select("case_id", "sub_type")


@register(
    "early_types",
    f"""WITH {b.CASES}, e AS (SELECT case_id, t, {rs.type_sql('t', True)} AS case_type FROM (SELECT *, lower(case_text) AS t FROM cases))
SELECT case_id, case_type, {rs.sub_sql('t', 'case_type', True)} AS sub_type FROM e""",
)
def _(spark, sf):
    df = labels.with_case_type(b.cases(spark, sf), T, early=True)
    return labels.with_sub_type(df, T, early=True).select("case_id", "case_type", "sub_type")


@register("verdict", f"WITH {rs.LABELLED} SELECT case_id, verdict FROM labelled")
def _(spark, sf):
    return labels.with_verdict(b.cases(spark, sf), T).select("case_id", "verdict")


@register(
    "verdict_group",
    f"WITH {rs.LABELLED} SELECT case_id, {rs.pattern_sql('lower(verdict)', outcomes.VERDICT_GROUPS, 'unknown')} AS verdict_group FROM labelled",
)
def _(spark, sf):
    df = labels.with_verdict(b.cases(spark, sf), T)
    return df.select("case_id", labels.verdict_group(F.col("verdict")).alias("verdict_group"))


_NOISY = "replace(replace(replace(verdict, 'Judgment ', 'Judgment''Is- '), 'Per Curiam: ', 'Per Curiam: —The J Udgment/ '), 'Award', '»AwardJs')"


def _noisy(c):
    out = F.replace(c, F.lit("Judgment "), F.lit("Judgment'Is- "))
    out = F.replace(out, F.lit("Per Curiam: "), F.lit("Per Curiam: —The J Udgment/ "))
    return F.replace(out, F.lit("Award"), F.lit("»AwardJs"))


@register("clean_ocr", f"WITH {rs.LABELLED} SELECT case_id, {rs.ocr_sql(_NOISY)} AS cleaned FROM labelled")
def _(spark, sf):
    df = labels.with_verdict(b.cases(spark, sf), T)
    return df.select("case_id", labels.clean_ocr(_noisy(F.col("verdict"))).alias("cleaned"))


FOUR = f"""four AS (SELECT *, {rs.map_sql('keyword', outcomes.FOUR_CLASS)} AS four_class_label FROM (
  SELECT *, {rs.pattern_sql('verdict_clean', outcomes.OUTCOME_KEYWORDS, 'UNKNOWN')} AS keyword FROM (
    SELECT *, {rs.ocr_sql('verdict')} AS verdict_clean FROM labelled)))"""


@register("four_class", f"WITH {rs.LABELLED}, {FOUR} SELECT case_id, verdict_clean, keyword, four_class_label FROM four")
def _(spark, sf):
    df = labels.with_four_class(labels.with_verdict(b.cases(spark, sf), T), "verdict")
    return df.select("case_id", "verdict_clean", "keyword", "four_class_label")


@register(
    "verify_rules",
    f"""WITH {rs.LABELLED}, {FOUR}, v AS (SELECT CAST(four_class_label = CASE WHEN contains(verdict, 'REVERSED') THEN 'REVERSED'
  WHEN contains(verdict, 'AFFIRMED') THEN 'AFFIRMED' ELSE 'NON_FINAL' END AS INT) AS ok FROM four)
SELECT count(*) AS total, CAST(sum(ok) AS BIGINT) AS passed, {b.r_even('avg(ok) * 100.0', 1)} AS accuracy FROM v""",
)
def _(spark, sf):
    df = labels.with_verdict(b.cases(spark, sf), T)
    v = F.col("verdict")
    expected = F.when(v.contains("REVERSED"), "REVERSED").when(v.contains("AFFIRMED"), "AFFIRMED")
    return labels.verify_rules(df.withColumn("expected", expected.otherwise("NON_FINAL")), "verdict", "expected")


@register("merge_case_type", f"WITH {rs.TYPED} SELECT case_id, {rs.map_sql('case_type', maps.CASE_TYPE_MERGED)} AS merged FROM typed")
def _(spark, sf):
    df = labels.with_case_type(b.cases(spark, sf), T)
    return df.select("case_id", labels.merge_case_type(F.col("case_type")).alias("merged"))


def _scheme_sql(scheme: str) -> str:
    mapping = maps.SUB_TYPE_SCHEMES[scheme]
    if scheme not in maps.LOWER_CASE_SCHEMES:
        return rs.map_sql("sub_type", mapping, "'OTHER'")
    lowered = rs.map_sql("lower(sub_type)", {k.lower(): v for k, v in mapping.items()}, "'OTHER'")
    return f"CASE WHEN contains(lower(sub_type), 'appeal') THEN 'APPELLATE_PROCEDURE' ELSE {lowered} END"


@register(
    "merge_sub_type",
    f"WITH {rs.TYPED} SELECT case_id, {', '.join(f'{_scheme_sql(s)} AS {s}' for s in maps.SUB_TYPE_SCHEMES)} FROM typed",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), T), T)
    return df.select("case_id", *[labels.merge_sub_type(F.col("sub_type"), s).alias(s) for s in maps.SUB_TYPE_SCHEMES])


@register(
    "hierarchy_labels",
    f"""WITH {rs.TYPED} SELECT case_id, {rs.map_sql('sub_type', maps.LEVEL_0, "'OTHER'")} AS l0_label,
  {rs.map_sql('sub_type', maps.LEVEL_1)} AS l1_label, {rs.map_sql('sub_type', maps.LEVEL_2_CIVIL)} AS l2_civil,
  {rs.map_sql('sub_type', maps.LEVEL_2_CRIMINAL)} AS l2_criminal FROM typed""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), T), T)
    return df.select("case_id", *[c.alias(n) for n, c in labels.hierarchy_labels(F.col("sub_type")).items()])


@register(
    "mapped_labels",
    f"WITH {rs.CLEANED} SELECT case_id, case_type_mapped, sub_type_mapped, verdict_mapped FROM cleaned",
)
def _(spark, sf):
    return b.cleaned(spark, sf).select("case_id", "case_type_mapped", "sub_type_mapped", "verdict_mapped")


@register(
    "label_leak_rate",
    f"""WITH {rs.TYPED} SELECT sub_type AS label, count(*) AS n,
  {b.r_even('avg(CAST(contains(lower(case_text), lower(sub_type)) AS INT))', 4)} AS leak_rate FROM typed GROUP BY 1""",
)
def _(spark, sf):
    df = labels.with_sub_type(labels.with_case_type(b.cases(spark, sf), T), T)
    return labels.label_leak_rate(df, "sub_type", T)


@register(
    "unmapped_audit",
    f"WITH {rs.CLEANED} SELECT verdict AS value, count(*) AS n FROM cleaned WHERE verdict_mapped = 'OTHER' GROUP BY 1",
)
def _(spark, sf):
    return labels.unmapped_audit(b.cleaned(spark, sf), "verdict", "verdict_mapped", "OTHER")


# -- projections ------------------------------------------------------------------

_BASE = (
    "case_id, CAST(NULL AS VARCHAR) AS case_name, year, court, case_type, sub_type, verdict, case_type_mapped, "
    "sub_type_mapped, verdict_mapped, num_citations, text_length, word_count"
)


@register("case_base", f"WITH {rs.CLEANED} SELECT {_BASE} FROM known")
def _(spark, sf):
    return filters.case_base(b.cleaned(spark, sf).filter("is_clean"))


@register(
    "case_detail",
    f"WITH {rs.CLEANED} SELECT {_BASE}, case_text, legal_citations, source_folder, CAST(year_numeric AS DOUBLE) AS year_numeric FROM known",
)
def _(spark, sf):
    return filters.case_detail(b.cleaned(spark, sf).filter("is_clean"))


@register(
    "verdict_rules",
    f"""SELECT o_orderkey, [{', '.join(lit(label) for _, label in VERDICT_TEXTS)}][CAST(o_orderkey % {len(VERDICT_TEXTS)} AS INT) + 1] AS verdict FROM orders""",
)
def _(spark, sf):
    """Every order as an opinion that ends as one of the verdict rules asks for; the verdicts are literals."""
    orders = spread(b.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), narrow=True)
    endings = b._pick([text for text, _ in VERDICT_TEXTS], "o_orderkey")
    df = orders.select("o_orderkey", F.concat_ws(" ", "o_orderstatus", endings).alias("text"))
    return labels.with_verdict(df, "text").select("o_orderkey", "verdict")
