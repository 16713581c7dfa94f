"""Citations: found in the text, merged with the sidecar's, parsed back from a joined cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casework.functions.text import SPACES

# The six citation forms.
CITATION_PATTERNS = (
    r"\d+\s+[A-Z][a-z]+\.?\s+\d+",
    r"\d+\s+[A-Z][a-z]+\.?\s+[A-Z]?\.?\s+\d+",
    r"\d+\s+U\.S\.\s+\d+",
    r"\d+\s+Blackf\.\s+\d+",
    r"\d+\s+Binn\.\s+\d+",
    r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+v\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?,"
    r"\s+\d+\s+[A-Za-z\.]+\s+\d+",
)


def extract_citations(text: Column, sidecar: Column | None = None) -> Column:
    """Distinct citations of the text and the sidecar, in code-point order."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CITATION_PATTERNS]
    if sidecar is not None:
        given = F.coalesce(sidecar, F.array().cast("array<string>"))
        found.append(F.filter(given, lambda x: x.isNotNull() & (x != "")))
    every = reduce(lambda a, b: F.concat(a, b), found)
    return F.sort_array(F.array_distinct(F.transform(every, lambda x: F.trim(x))))


def citation_count(citations: Column) -> Column:
    """Counted before any cut of the joined list."""
    return F.size(citations)


def joined_citations(citations: Column, limit: int | None = None) -> Column:
    """All citations in one cell; with *limit* (``STORED_CITATIONS`` for display) only the first ones."""
    return F.array_join(citations if limit is None else F.slice(citations, 1, limit), "; ")


def parse_citation_list(cell: Column) -> Column:
    """Split a ``;`` joined cell; lower, collapse spaces, drop blanks and repeats in order."""
    parts = F.split(F.coalesce(cell, F.lit("")), ";")
    tidy = F.transform(parts, lambda x: F.lower(F.trim(F.regexp_replace(x, SPACES, " "))))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))
