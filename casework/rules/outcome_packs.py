"""Verdict phrases reduced to groups, to keywords and to the four outcome classes."""

# Verdict groups in order, by pattern on the lower-cased verdict.
VERDICT_GROUPS = [
    ("affirm", "affirmed"),
    ("revers", "reversed"),
    ("remand", "remanded"),
    ("dismiss", "dismissed"),
    ("(?:judgment|verdict|decree) for plaintiff", "plaintiff_wins"),
    ("(?:judgment|verdict) for defendant", "defendant_wins"),
    ("award granted|claim allowed|award recommended", "award_granted"),
    ("award denied|claim disallowed|claim denied", "award_denied"),
]
UNKNOWN_GROUP = "unknown"

# Scanning-error repairs, applied in order.
SCAN_REPAIRS = [
    (r"(?<=[a-zA-Z])(?=[A-Z][a-z])", " "),
    ("['`´]", ""),
    (r"[.\-]+(?=\s*(?:REVERSED|AFFIRMED|IS|ARE)\b)", " "),
    (r"\bJs\b", "Is"),
    (r":Udoment\b", "Judgment"),
    (r"\bJ\s+Udgment\b", "Judgment"),
    (r"\bMrsj\b", "Mrs."),
    (r"(?U)\bTíre\b", "The"),
    (r"\bSb\b", "So"),
    ("»", "-"),
    ("¡", " "),
    (r"^/\s*", ""),
    (r"\s/\s*", " "),
    ("•", " "),
    (r"&C\.?", "etc."),
]

# Keyword of a cleaned verdict, first pattern found wins.
OUTCOME_KEYWORDS = [
    (r"\bAFFIRMED\b.{0,60}\bIN\s+PART\b|\bIN\s+PART\b.{0,60}\bAFFIRMED\b", "AFFIRMED_IN_PART"),
    (r"\bREVERSED\b.{0,60}\bIN\s+PART\b|\bIN\s+PART\b.{0,60}\bREVERSED\b", "REVERSED_IN_PART"),
    (
        r"\b(?:AS\s+TO\s+THE\s+COSTS?|RESPECTING\s+THE\s+DOCKET|FOR\s+COSTS?\s+IS\s+REVERSED"
        r"|AGAINST\s+THE\s+DEFENDANT\s+FOR\s+COSTS|DISCHARGED\s+THE\s+DEFENDANTS\s+FROM\s+THE\s+COSTS"
        r"|GIVES\s+COSTS\s+TO\s+THE\s+PLAINTIFF)\b.{0,80}\bREVERSED\b",
        "REVERSED_COSTS",
    ),
    (r"\bSET\s+ASIDE\b", "SET_ASIDE"),
    (r"\bARREST\s+OF\s+JUDGMENT\b", "ARREST_JUDGMENT"),
    (r"\bAFFIRMED\b", "AFFIRMED"),
    (r"\bREVERSED\b", "REVERSED"),
    (r"\bDISMISSED\b", "DISMISSED"),
    (r"\bREMANDED\b", "REMANDED"),
    (r"\bQUASHED\b", "QUASHED"),
    (r"\bOVERRULED\b", "OVERRULED"),
    (r"\bSUSTAINED\b", "SUSTAINED"),
    (r"\bDENIED\b", "DENIED"),
    (r"\bGRANTED\b", "GRANTED"),
    (r"\bDISSOLVED\b", "DISSOLVED"),
    (r"\bREFUSED\b", "REFUSED"),
    (r"\bGIVEN\b", "GIVEN"),
    (r"^\s*VOID\s*$|\bJUDGMENT\s+VOID\b", "VOID"),
    (r"^\s*BARRED\s*$|\bRECOVERY\s+BARRED\b", "BARRED"),
    (r"\bDECREE\s+FOR\s+COMPLAINANT\b", "DECREE_COMPLAINANT"),
    (r"\bPLEA\s+GOOD\b", "PLEA_GOOD"),
    (r"\bPLEA\s+INSUFFICIENT\b", "PLEA_INSUFFICIENT"),
    (r"\bERROR\s+FOUND\b", "ERROR_FOUND"),
    (r"NO\s+FINAL\s+JUDGMENT", "NO_FINAL_JUDGMENT"),
    (r"\bGUILTY\b", "GUILTY"),
]
UNKNOWN_KEYWORD = "UNKNOWN"

# The class of each keyword.
FOUR_CLASS = {
    "AFFIRMED": "AFFIRMED",
    "AFFIRMED_IN_PART": "AFFIRMED",
    "DECREE_COMPLAINANT": "AFFIRMED",
    "REVERSED": "REVERSED",
    "REVERSED_IN_PART": "REVERSED",
    "REVERSED_COSTS": "REVERSED",
    "SET_ASIDE": "REVERSED",
    "ARREST_JUDGMENT": "REVERSED",
    "ERROR_FOUND": "REVERSED",
    "DISMISSED": "DISMISSED",
    "APPEAL_DISMISSED": "DISMISSED",
    "BARRED": "DISMISSED",
    "REMANDED": "NON_FINAL",
    "QUASHED": "NON_FINAL",
    "OVERRULED": "NON_FINAL",
    "SUSTAINED": "NON_FINAL",
    "DENIED": "NON_FINAL",
    "GRANTED": "NON_FINAL",
    "DISSOLVED": "NON_FINAL",
    "REFUSED": "NON_FINAL",
    "GIVEN": "NON_FINAL",
    "VOID": "NON_FINAL",
    "PLEA_GOOD": "NON_FINAL",
    "PLEA_INSUFFICIENT": "NON_FINAL",
    "NO_FINAL_JUDGMENT": "NON_FINAL",
    "GUILTY": "NON_FINAL",
    "UNKNOWN": "NON_FINAL",
}
FOUR_CLASSES = ("AFFIRMED", "REVERSED", "DISMISSED", "NON_FINAL")

# Our default for the five-label verdict map, which the caller may replace.
VERDICT_CLASSES = [
    ("affirm", "AFFIRMED"),
    ("revers", "REVERSED"),
    ("den(?:y|ied)", "DENIED"),
    ("grant", "GRANTED"),
]
OTHER = "OTHER"
