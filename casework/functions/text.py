"""Scalar text functions. All are built-in expressions; none needs a Python worker."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.isspace() accepts.
SPACE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
SPACES = SPACE + "+"
PAGE_MARK = r"\*\p{Nd}+"
AMOUNT = r"\$([\d,]+(?:\.\d{2})?)"

UNKNOWN = "Unknown"
STORED_CHARS = 10_000
STORED_CITATIONS = 20
DEFAULT_COURT = "Supreme Court of Indiana"

# The twelve case-insensitive flag patterns.
FLAG_PATTERNS = {
    "flag_per_curiam": r"per curiam",
    "flag_dissent": r"dissent(?:ing)?",
    "flag_has_amount": r"\$[\d,]+(?:\.\d{2})?",
    "flag_criminal": r"indictment|guilty|felony|larceny|homicide",
    "flag_contract": r"promissory note|breach of contract|consideration",
    "flag_property": r"ejectment|mortgage|foreclosure|adverse possession",
    "flag_appeal": r"writ of error|on appeal|appealed from",
    "flag_negligence": r"negligence|contributory|proximate cause",
    "flag_injunction": r"injunction|enjoined",
    "flag_award": r"award (?:granted|denied|made|refused)",
    "flag_affirmed": r"\baff?irm(?:ed|ance)?\b",
    "flag_reversed": r"\brevers(?:ed|al)?\b",
}


def none_if_empty(c: Column) -> Column:
    """``regexp_extract`` answers '' for no match; make that a null."""
    return F.nullif(c, F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_text(c: Column) -> Column:
    """Drop ``*12`` page marks, collapse white space, trim."""
    return collapse_spaces(F.regexp_replace(c, PAGE_MARK, ""))


def truncate(c: Column, limit: int) -> Column:
    """At most *limit* characters, cut back to the last space."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def stored_text(c: Column) -> Column:
    """The head of the text for display; the case table keeps all of it unless asked to cut."""
    return F.substring(c, 1, STORED_CHARS)


def extract_year(decision_date: Column, text: Column) -> Column:
    """Year of the sidecar date, else the first 1800-2099 in the text, else Unknown."""
    return F.coalesce(
        none_if_empty(F.regexp_extract(decision_date, r"(\d{4})", 1)),
        none_if_empty(F.regexp_extract(text, r"(?U)\b((?:18|19|20)\d{2})\b", 1)),
        F.lit(UNKNOWN),
    )


def year_in_text(text: Column) -> Column:
    return none_if_empty(F.regexp_extract(text, r"(?U)\b(1[7-9]\d{2}|20\d{2})\b", 1))


def fix_year(c: Column) -> Column:
    """First 1600-2029 of a year cell; blanks and placeholders become Unknown."""
    cell = F.trim(c.cast("string"))
    year = none_if_empty(F.regexp_extract(cell, r"(1[6-9]\d{2}|20[0-2]\d)", 1))
    placeholder = F.lower(cell).isin("", "nan", "none", "unknown", "#########")
    return F.coalesce(F.when(~placeholder, year), F.lit(UNKNOWN))


def year_number(c: Column) -> Column:
    return c.try_cast("int")


def extract_court(court: Column, text: Column) -> Column:
    state = none_if_empty(F.regexp_extract(text, r"Supreme Court of ([A-Za-z]+)", 1))
    return F.coalesce(
        none_if_empty(court), F.concat(F.lit("Supreme Court of "), state), F.lit(DEFAULT_COURT)
    )


_PARTY = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
CAPTION = rf"^({_PARTY}(?:\s+and\s+[A-Z][a-z]+)?)\s+v\.\s+({_PARTY})"


def extract_case_name(name: Column, text: Column, stem: Column) -> Column:
    """Sidecar name, else an ``A v. B`` caption at the start, else the file stem."""
    head = F.substring(text, 1, 500)
    caption = F.when(
        head.rlike(CAPTION),
        F.concat(
            F.regexp_extract(head, CAPTION, 1), F.lit(" v. "), F.regexp_extract(head, CAPTION, 2)
        ),
    )
    return F.coalesce(none_if_empty(name), caption, stem)


def case_id_from_stem(stem: Column) -> Column:
    return F.coalesce(none_if_empty(F.regexp_extract(stem, r"(\d{4})", 1)), stem)


def first_amount(c: Column) -> Column:
    """First dollar amount with its sign, null when there is none."""
    return none_if_empty(F.regexp_extract(c, AMOUNT, 0))


def word_count(c: Column) -> Column:
    text = collapse_spaces(c)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(text, " "))
    )


def is_empty(c: Column) -> Column:
    return ~F.coalesce(c.rlike("[^" + SPACE[1:]), F.lit(False))


def clean_case_name(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def title_case(c: Column) -> Column:
    """Capital after any non-letter (``Judgment'Is``), which ``initcap`` does not do."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            # initcap of the upper-cased letter: one that widens, as in 'Ss', keeps one capital
            lambda x: F.concat(F.initcap(F.upper(F.substring(x, 1, 1))), x.substr(F.lit(2), F.length(x))),
        ),
        "",
    )


def clean_legal_text(c: Column) -> Column:
    """Lower case; runs of white space and of digits, and any other non a-z, to a space; trim."""
    out = F.lower(c)
    for pattern in (SPACES, r"\p{Nd}+", r"[^a-z ]"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def legal_flags(c: Column) -> dict[str, Column]:
    """Twelve 0/1 indicator columns."""
    text = F.coalesce(c, F.lit(""))
    return {
        name: text.rlike("(?iu)" + pattern).cast("int") for name, pattern in FLAG_PATTERNS.items()
    }


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one letter plus marks."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(code))
        base = "".join(p for p in parts if not unicodedata.combining(p))
        if base != chr(code) and len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents; free combining marks are dropped."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")
