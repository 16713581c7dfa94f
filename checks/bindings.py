"""How the test tables are read as a case collection, in Spark and in the checking SQL.

The documents hold invented prose, so each gets a heading and a closing phrase
picked by its id; texts are used whole. Orders serve as cases where only
year, labels and a count matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions.citations import citation_count, extract_citations, joined_citations
from casework.functions.text import SPACES
from casework.functions.words import collapsed
from casework.plans.case_table import clean_cases, label_cases
from casework.session import compute_once, cut_lineage, spread

HEADINGS = [
    "Smith v. Jones appeared before the court.",
    "In the Supreme Court of Ohio the judges met.",
    "Allen Moore and Clark v. Baker Hill, an action brought in 1871.",
    "Page*12 of the report.",
    "No caption here.",
]
PHRASES = [
    "action for slander, slanderous words spoken by defendant.",
    "indictment for grand larceny. defendant found guilty.",
    "suit on a promissory note for debt. the judgment is affirmed.",
    "action of ejectment to recover possession of land; the decree is reversed with costs.",
    "defendant demurred to the declaration; the demurrer is sustained.",
    "plaintiff claims negligence caused personal injury. judgment for the plaintiff for $2,500.",
    "Per Curiam. The judgment of the court below is reversed with costs.",
    "the jury found the defendant guilty of murder.",
    "an award is made accordingly in the sum of $750.00.",
    "we are constrained to refuse an award in this matter.",
    "the settlement is ratified and confirmed. $1,200.00.",
    "See 12 Conn. 345 and 347 U.S. 483. Also 12 Conn. 345; the bill is dismissed.",
    "Cf. Brown v. Green, 7 Blackf. 200. cause remanded for further proceedings.",
    "verdict was in favour of the plaintiff.",
    "for the reasons stated, the claim is disallowed.",
    "the temporary injunction prayed for may issue.",
    "the plaintiff is entitled to a decree of divorce.",
    "judgment may be entered against the defendants for $3,100.",
    "writ of fieri facias; the execution and levy by the sheriff were in error. execution quashed.",
    "Nothing further was said between them.",
    "murder and manslaughter. per curiam. the finding below must be set aside",
    "we hereby make an award of $300 to him.",
    "the claims are allowed in the amount of the bills: $1,000.50 and $2.25.",
    "in my judgment an award should be made of $90.",
    "appeal from the common pleas on a bond; plea overruled.",
    "issues are found in favor of the plaintiffs on the mortgage.",
    "the motion is denied. 3 Binn. 11.",
    "a new trial is granted for trespass and conversion.",
    "award to william c. mclver on his claim, $100.00 and $50.",
    "the decree was affirmed with costs.",
    "an instruction was refused by him.",
    "decree for the heirs in usury; judgment may enter without costs.",
    "judgment as to the debt is affirmed and as to the damages reversed.",
    "assault and battery; it is hereby dismissed.",
    "habeas corpus. the matter was held over so that error shows.",
    "libel and defamation; liability and damages are stipulated at $40.",
    "counterfeiting and perjury; decree of divorce granted.",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _pick(values: list[str], key: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    year = F.when(F.col("doc_id") % 17 == 0, "Unknown").otherwise((1850 + F.col("doc_id") % 40).cast("string"))
    return docs.select(
        F.col("doc_id").cast("string").alias("case_id"),
        F.col("source").alias("source_folder"),
        year.alias("year"),
        F.concat(F.lit("Supreme Court of "), F.upper("lang")).alias("court"),
        F.concat_ws(" ", _pick(HEADINGS, "doc_id"), collapsed(F.col("text")), _pick(PHRASES, "doc_id")).alias(
            "case_text"
        ),
    )


_written: dict[tuple[str, str], DataFrame] = {}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled case table, written once per session as an extraction run would, then read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = cut_lineage(label_cases(cases(spark, sf_dir)), "cases")
    return _written[key]


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with their citation columns only."""
    df = compute_once(cases(spark, sf_dir), {"citations": extract_citations(F.col("case_text"))})
    return df.withColumns(
        {"num_citations": citation_count(F.col("citations")), "legal_citations": joined_citations(F.col("citations"))}
    )


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_cases(labelled(spark, sf_dir))


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("case_id"),
        F.year("o_orderdate").alias("year_numeric"),
        F.col("o_orderpriority").alias("case_type_mapped"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("sub_type_mapped"),
        F.col("o_orderstatus").alias("verdict_mapped"),
        F.concat(F.lit("Court "), (F.col("o_custkey") % 25).cast("string")).alias("court"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 10).cast("int")).alias("num_citations"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a true label and a prediction that is wrong for every fourth key."""
    o = table(spark, sf_dir, "orders").filter("o_orderpriority IS NOT NULL")
    wrong = F.when(F.col("o_orderkey") % 8 == 0, "1-URGENT").otherwise(F.col("o_orderstatus"))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("true"),
        F.when(F.col("o_orderkey") % 4 == 0, wrong).otherwise(F.col("o_orderpriority")).alias("pred"),
    )


# -- the same in checking SQL -------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _choose(values: list[str], key: str) -> str:
    return f"[{', '.join(lit(v) for v in values)}][CAST({key} % {len(values)} AS INT) + 1]"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, {lit(SPACES)}, ' ', 'g'))"


CASES = f"""cases AS MATERIALIZED (
  SELECT CAST(doc_id AS VARCHAR) AS case_id, source AS source_folder,
    CASE WHEN doc_id % 17 = 0 THEN 'Unknown' ELSE CAST(1850 + doc_id % 40 AS VARCHAR) END AS year,
    'Supreme Court of ' || upper(lang) AS court,
    {_choose(HEADINGS, 'doc_id')} || ' ' || {collapse('text')} || ' ' || {_choose(PHRASES, 'doc_id')} AS case_text
  FROM documents)"""

ORDER_CASES = """oc AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS case_id, CAST(year(o_orderdate) AS INT) AS year_numeric,
    o_orderpriority AS case_type_mapped, o_orderpriority || '/' || o_orderstatus AS sub_type_mapped,
    o_orderstatus AS verdict_mapped, 'Court ' || CAST(o_custkey % 25 AS VARCHAR) AS court,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 10 AS INT) END AS num_citations
  FROM orders)"""

PREDICTIONS = """p AS (
  SELECT o_orderkey AS id, o_orderpriority AS "true",
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority
         WHEN o_orderkey % 8 = 0 THEN '1-URGENT' ELSE o_orderstatus END AS pred
  FROM orders WHERE o_orderpriority IS NOT NULL)"""


def r_even(x: str, digits: int) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} + 0e0)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"CASE WHEN {whole} > 0 THEN {r_even(f'CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100.0', digits)} ELSE 0.0 END"


FILE_SIDES = """sides AS (SELECT 'source ' || page_id % 7 AS source, 'case-' || page_id AS stem, coalesce(html, '') AS html,
  '{"id": ' || page_id || '}' AS json, page_id % 11 <> 0 AS has_html, page_id % 13 <> 0 AS has_json FROM pages)"""


def write_case_files(spark: SparkSession, sf_dir: str, root: str, *kinds: str) -> None:
    """The pages as files below *root*, one side missing here and there; every task writes its own."""
    pages = table(spark, sf_dir, "pages")
    number = F.col("page_id")
    sides = {
        "html": (F.coalesce(F.col("html"), F.lit("")), number % 11 != 0),
        "json": (F.concat(F.lit('{"id": '), number.cast("string"), F.lit("}")), number % 13 != 0),
    }
    source, stem = F.concat(F.lit("source "), (number % 7).cast("string")), F.concat(F.lit("case-"), number.cast("string"))

    def write(batches):
        from pyarrow import fs

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(content.encode())
            yield batch.slice(0, 0)

    for kind in kinds:
        content, there = sides[kind]
        path = F.concat(F.lit(f"{root}/"), source, F.lit(f"/{kind}/"), stem, F.lit(f".{kind}"))
        pages.filter(there).select(path.alias("path"), content.alias("content")).mapInArrow(write, "path string, content string").collect()
