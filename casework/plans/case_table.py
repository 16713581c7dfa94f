"""From raw pages to the typed case table, in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.functions import citations as cites
from casework.functions import text as txt
from casework.functions.pages import page_text
from casework.functions.sidecar import parse_sidecar
from casework.rules import labels
from casework.schemas import CASE
from casework.session import compute_once


LABELS = ("case_type", "sub_type", "verdict", "citations", "num_citations", "legal_citations")


def _with_rules(df: DataFrame, text: str, wanted: set[str], block_out: str | None = None) -> DataFrame:
    """The rule packs that *wanted* columns need; the sub-type is found within the type the row has."""
    if "case_type" in wanted or ("sub_type" in wanted and "case_type" not in df.columns):
        df = labels.with_case_type(df, text)
    if "sub_type" in wanted:
        df = labels.with_sub_type(df, text)
    if "verdict" in wanted:
        df = labels.with_verdict(df, text, block_out=block_out)
    return df


def label_cases(
    df: DataFrame,
    text: str = "case_text",
    block_out: str | None = None,
    citation_limit: int | None = None,
    columns: Sequence[str] = LABELS,
) -> DataFrame:
    """Add case_type, sub_type, verdict and the citation columns to rows that hold a text.

    *columns* names the ones to add; rules that none of them needs are not planned. A later
    ``select`` cannot drop a cascade, because values are computed behind a barrier (``compute_once``).
    """
    wanted = set(columns)
    if wanted - set(LABELS):
        raise ValueError(f"no label columns: {sorted(wanted - set(LABELS))}")
    kept = df.columns
    df = _with_rules(df, text, wanted, block_out)
    if wanted & set(LABELS[3:]):
        df = compute_once(df, {"_cites": cites.extract_citations(F.col(text))})
        found = {
            "citations": F.col("_cites"),
            "num_citations": cites.citation_count(F.col("_cites")),
            "legal_citations": cites.joined_citations(F.col("_cites"), citation_limit),
        }
        df = df.withColumns({name: c for name, c in found.items() if name in wanted})
    order = [name for label in LABELS for name in ([label, block_out] if label == "verdict" else [label])]
    added = [c for c in order if c in wanted or (c and c == block_out and "verdict" in wanted)]
    return df.select(*[c for c in kept if c not in added], *added)


def process_cases(
    raw: DataFrame,
    cut_text: bool = False,
    citation_limit: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(source, stem, html, json) rows to the sixteen-column case table; pages without text drop out.

    Texts and citation lists are whole. *cut_text* and *citation_limit* give the forms for display.
    *columns* names the columns to build, all by default; rules that none of them needs are not planned.
    """
    names = [f.name for f in CASE.fields]
    unknown = set(columns or ()) - set(names)
    if unknown:
        raise ValueError(f"no columns of the case table: {sorted(unknown)}")
    wanted = set(names if columns is None else columns)
    df = compute_once(raw, {"_page": page_text(F.col("html"))}).drop("html")
    df = compute_once(df, {"_text": txt.clean_text(F.col("_page"))}).filter(F.col("_text") != "")
    df = parse_sidecar(df, "json")
    text = F.col("_text")
    df = _with_rules(df, "_text", wanted)
    if wanted & {"num_citations", "legal_citations"}:
        df = compute_once(df, {"_cites": cites.extract_citations(text, F.col("sidecar_citations"))})
    values = {
        "case_id": txt.case_id_from_stem(F.col("stem")),
        "case_name": txt.extract_case_name(F.col("name"), text, F.col("stem")),
        "source_folder": F.col("source"),
        "year": txt.extract_year(F.col("decision_date"), text),
        "court": txt.extract_court(F.col("court_name"), text),
        "case_text": txt.stored_text(text) if cut_text else text,
        "case_text_full_length": F.length("_page"),
        "num_citations": cites.citation_count(F.col("_cites")),
        "legal_citations": cites.joined_citations(F.col("_cites"), citation_limit),
    }
    return df.select(
        *[values.get(name, F.col(name)).cast(CASE[name].dataType).alias(name) for name in (columns or names)]
    )


def clean_cases(cases: DataFrame, **maps) -> DataFrame:
    """Mapped labels, repaired year, numeric twins and the clean/unknown flag; blank texts drop out.

    Tables without one of the label columns lack its mapped twin, and the flag if it needs it.
    """
    df = cases.filter(~txt.is_empty(F.col("case_text")))
    df = df.withColumn("year", txt.fix_year(F.col("year")))
    df = labels.with_mapped_labels(df, **maps)
    df = df.withColumns(
        {
            "year_numeric": txt.year_number(F.col("year")),
            "text_length": F.length("case_text"),
            "word_count": txt.word_count(F.col("case_text")),
        }
    )
    if not {"case_type_mapped", "verdict_mapped"} <= set(df.columns):
        return df
    known = (F.col("case_type_mapped") != "Unclassified") & (F.col("verdict_mapped") != "OTHER")
    return df.withColumn("is_clean", known)


def split_clean_unknown(cleaned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rows with an unknown target): two filters over one table."""
    return cleaned.filter("is_clean").drop("is_clean"), cleaned.filter("NOT is_clean").drop("is_clean")
