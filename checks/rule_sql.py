"""The rule packs written out as checking SQL.

The packs are data, so both engines must read the same tables; the expressions
around them are written anew here, without gates and anchors, so that a row the
Spark plan skips wrongly would show.
"""

from __future__ import annotations

from casework.functions.citations import CITATION_PATTERNS
from casework.rules import label_maps as maps
from casework.rules import outcome_packs as outcomes
from casework.rules import type_packs as packs
from casework.rules.engine import WINDOWS, Dialect, RuleSql, contains_any, keyword_sql, quote_plain
from casework.rules.verdict_pack import UNKNOWN_VERDICT, VERDICT_BLOCKS
from checks.bindings import CASES, collapse, lit

_NUMBERS = "list_transform({a}, lambda x: try_cast(replace(x, ',', '') AS DOUBLE))"
DUCK = Dialect(
    quote=lit,
    like="regexp_matches({c}, {p})",
    title=(
        "array_to_string(list_transform(regexp_extract_all(lower(trim({c})), {p}),"
        " lambda x: CASE WHEN left(x, 1) = 'ß' THEN 'Ss' ELSE upper(left(x, 1)) END || substr(x, 2)), '')"
    ),
    every="regexp_extract_all({c}, {p}, 1)",
    first_two="CASE WHEN len({a}) > 1 THEN ({a})[1] || ' + $' || ({a})[2] END",
    total=(
        f"CASE WHEN len({{a}}) > 0 AND list_count({_NUMBERS}) = len({{a}})"
        f" THEN format('{{{{:,.2f}}}}', list_sum({_NUMBERS})) END"
    ),
    shortcuts=False,
)


def verdict_sql(lower: str) -> tuple[str, str]:
    """(window columns, verdict expression) over a lower-cased column."""
    cuts, names = [], {"text": lower}
    for name, (side, length, of) in WINDOWS.items():
        source = lower if of == "text" else f"right({lower}, {WINDOWS[of][1]})"
        cuts.append(f"{side}({source}, {length}) AS {name}")
        names[name] = name
    sql = RuleSql(names, DUCK)
    labels = ", ".join(sql.block((), rules) for _, _, rules in VERDICT_BLOCKS)
    return ", ".join(cuts), f"coalesce({labels}, '{UNKNOWN_VERDICT}')"


def type_sql(lower: str, early: bool = False) -> str:
    weights = packs.EARLY_TYPE_WEIGHTS if early else packs.TYPE_WEIGHTS
    defamation = packs.EARLY_DEFAMATION_WORDS if early else packs.DEFAMATION_WORDS
    scores = {
        name: "("
        + " + ".join(f"CAST(contains({lower}, {lit(w)}) AS INT) * {v}" for w, v in entries)
        + ")"
        for name, entries in weights.items()
    }
    best = f"greatest({', '.join(scores.values())})"
    whens = " ".join(f"WHEN {s} = {best} THEN {lit(name)}" for name, s in scores.items())
    return (
        f"CASE WHEN {contains_any(lower, defamation)} THEN '{packs.DEFAMATION}' "
        f"WHEN {best} = 0 THEN '{packs.UNCLASSIFIED}' {whens} END"
    )


def sub_sql(lower: str, case_type: str, early: bool = False) -> str:
    lists = packs.EARLY_SUB_TYPES if early else packs.SUB_TYPES
    general = packs.EARLY_ANY_TYPE if early else packs.ANY_TYPE
    whens = " ".join(
        f"WHEN {case_type} = {quote_plain(name)} THEN {keyword_sql(lower, *groups)}" for name, groups in lists.items()
    )
    return f"CASE {whens} ELSE {keyword_sql(lower, *general)} END"


def citation_sql(text: str) -> str:
    found = " || ".join(f"regexp_extract_all({text}, {lit(p)})" for p in CITATION_PATTERNS)
    return f"list_sort(list_distinct(list_transform({found}, lambda x: trim(x))))"


def map_sql(c: str, mapping: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {c} {whens} ELSE {default} END"


def pattern_sql(c: str, groups, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({c}, {lit(p)}) THEN {lit(label)}" for p, label in groups)
    return f"CASE {whens} ELSE {lit(default)} END"


def ocr_sql(c: str) -> str:
    """The repairs without look-around, which RE2 lacks: captures put back what was only looked at."""
    out = collapse(f"coalesce({c}, '')")
    split = r"([a-zA-Z])([A-Z][a-z])"
    steps = []
    for pattern, replacement in outcomes.SCAN_REPAIRS:
        if pattern.startswith("(?<="):
            steps += [(split, r"\1 \2"), (split, r"\1 \2")]  # twice: matches may touch
        elif "(?=" in pattern:
            steps.append((r"[.\-]+(\s*(?:REVERSED|AFFIRMED|IS|ARE)\b)", r" \1"))
        else:
            steps.append((pattern.replace("(?U)", ""), replacement))
    for pattern, replacement in steps:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return f"upper({collapse(out)})"


_windows, _verdict = verdict_sql("t")
TYPED = f"""{CASES},
typed AS MATERIALIZED (
  SELECT *, {sub_sql('t', 'case_type')} AS sub_type
  FROM (SELECT *, {type_sql('t')} AS case_type FROM (SELECT *, lower(case_text) AS t FROM cases)))"""
LABELLED = f"""{TYPED},
labelled AS MATERIALIZED (
  SELECT *, CAST(len(citations) AS INT) AS num_citations,
    array_to_string(citations, '; ') AS legal_citations
  FROM (SELECT * EXCLUDE ({', '.join(WINDOWS)}), {_verdict} AS verdict, {citation_sql('case_text')} AS citations
        FROM (SELECT *, {_windows} FROM typed)))"""
_sub_labels = {name: f"{group}__{name}" for name, group in maps.LEVEL_0.items()}
CLEANED = f"""{LABELLED},
cleaned AS MATERIALIZED (
  SELECT * EXCLUDE (year), coalesce(nullif(regexp_extract(year, '(1[6-9]\\d{{2}}|20[0-2]\\d)', 1), ''), 'Unknown') AS year,
    {map_sql('case_type', maps.CASE_TYPE_MERGED, "'Unclassified'")} AS case_type_mapped,
    {map_sql('sub_type', _sub_labels, "'UNCLASSIFIED__General'")} AS sub_type_mapped,
    {pattern_sql('lower(verdict)', outcomes.VERDICT_CLASSES, 'OTHER')} AS verdict_mapped,
    try_cast(year AS INT) AS year_numeric,
    CAST(length(case_text) AS INT) AS text_length,
    CAST(len(string_split(case_text, ' ')) AS INT) AS word_count
  FROM labelled),
known AS (SELECT * FROM cleaned WHERE case_type_mapped <> 'Unclassified' AND verdict_mapped <> 'OTHER')"""
