"""Ordered text rules compiled to one SQL expression.

A rule pack is data: ordered blocks of :class:`Rule`. ``first_match`` turns a
pack into a nullable CASE per block inside a COALESCE, so a row that matches
early never evaluates what comes later. SQL text rather than nested Column
calls: a cascade of some 260 rules is one parse instead of thousands of calls
into the JVM.

Cost. ``RLIKE`` decodes the whole string before it can look at it, and
``contains`` walks over the text once for each word. Each pattern therefore gets
an *anchor*: the longest word it cannot match without. A row lacking the anchor
skips the regular expression. A block has *gate* words of which each of its rules
needs one; a row with none of them skips the block. All these words are looked for
together, before the cascade (``found_words``), which then reads flags.

Patterns are written with a plain blank for one or more white-space characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.functions.text import AMOUNT
from casework.functions.words import found_words
from casework.session import compute_once

BARE_AMOUNT = r"\$?([\d,]+(?:\.\d{2})?)"
DIGIT_RUN = r"[\$\d,]+"

# Named parts of the lower-cased text that rules look at: (side, length, of which part).
WINDOWS = {
    "tail_2500": ("right", 2500, "text"),
    "tail_1500": ("right", 1500, "text"),
    "tail_1000": ("right", 1000, "text"),
    "tail_600": ("right", 600, "text"),
    "tail_500": ("right", 500, "text"),
    "head_500": ("left", 500, "text"),
    "head_2000": ("left", 2000, "text"),
    "opening": ("left", 1000, "tail_2500"),
}

# Amount sources: (window, pattern, group).
AMOUNTS = {
    "any": ("text", AMOUNT, 1),
    "tail_500": ("tail_500", AMOUNT, 1),
    "tail_1000": ("tail_1000", AMOUNT, 1),
    "bare": ("text", BARE_AMOUNT, 1),
    "bare_500": ("tail_500", BARE_AMOUNT, 1),
    "run": ("text", DIGIT_RUN, 0),
    "after_award": ("after_award", DIGIT_RUN, 0),
}


@dataclass(frozen=True)
class Rule:
    """One step of a cascade.

    ``label`` may name the match groups ``{1}``, ``{1U}`` (upper case), ``{1T}``
    (title case) and ``{amt}``. A rule with an ``amount`` source that finds no
    amount gives ``bare``, or does not fire when ``bare`` is None.
    """

    label: str
    patterns: tuple[str, ...] = ()
    window: str = "text"
    has: tuple[str, ...] = ()
    has_any: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    lacks_pattern: tuple[str, str] | None = None
    group_has: str | None = None
    group_filled: bool = False
    costs: bool = False
    amount: str | None = None
    bare: str | None = None


def rule(label: str, *patterns: str, **options) -> Rule:
    for name in ("has", "has_any", "lacks"):
        value = options.get(name, ())
        options[name] = (value,) if isinstance(value, str) else tuple(value)
    return Rule(label, patterns, **options)


def regex(pattern: str) -> str:
    return pattern.replace(" ", r"\s+")


def fixed_words(pattern: str) -> list[str]:
    """Words every match of *pattern* must hold; none when it has top-level choices."""
    words, word, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch.isalpha() or ch in "'-":
            word += ch if depth == 0 else ""
        else:
            if ch in "?*{":
                word = word[:-1]
            words.append(word)
            word = ""
            if ch == "|" and depth == 0:
                return []
            if ch == "\\":
                i += 1
            elif ch == "[":
                i = pattern.index("]", i)
            elif ch == "{":
                i = pattern.index("}", i)
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
        i += 1
    return [w for w in [*words, word] if w]


def anchor(pattern: str) -> str:
    return max(fixed_words(pattern), key=len, default="")


def split_window(text: str) -> tuple[str, str]:
    """``tail_500:affirmed`` looks in a window, ``affirmed`` in the whole text."""
    window, colon, rest = text.partition(":")
    return (window, rest) if colon and window in WINDOWS else ("text", text)


def label_parts(label: str) -> list[tuple[str, str]]:
    """Split a label into ('text', ..) and ('slot', ..) parts."""
    parts = []
    for i, piece in enumerate(label.replace("}", "{").split("{")):
        if piece:
            parts.append(("slot" if i % 2 else "text", piece))
    return parts


def quote(text: str) -> str:
    """A raw SQL literal; texts with an apostrophe use the other quote."""
    return f'r"{text}"' if "'" in text else f"r'{text}'"


@dataclass(frozen=True)
class Dialect:
    """The few spots where SQL engines differ."""

    quote: Callable[[str], str] = quote
    like: str = "{c} RLIKE {p}"
    title: str = (
        "array_join(transform(regexp_extract_all(lower(trim({c})), {p}, 0),"
        " x -> concat(initcap(upper(left(x, 1))), substr(x, 2))), '')"
    )
    every: str = "regexp_extract_all({c}, {p}, 1)"
    first_two: str = "CASE WHEN size({a}) > 1 THEN concat(get({a}, 0), ' + $', get({a}, 1)) END"
    # One unreadable amount (commas only) leaves no total.
    total: str = (
        "CASE WHEN size({a}) > 0 THEN format_number(aggregate(transform({a},"
        " x -> try_cast(replace(x, ',') AS DOUBLE)), 0D, (s, x) -> s + x), 2) END"
    )
    shortcuts: bool = True


SPARK = Dialect()


class Found:
    """The words that a cascade asks for, and the column that holds a flag for each."""

    def __init__(self, column: str):
        self.column, self.words = column, {}

    def flag(self, word: str) -> str:
        return f"get({self.column}, {self.words.setdefault(word, len(self.words))})"

    def add_to(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn(self.column, found_words(F.col(text), list(self.words)))


class RuleSql:
    """Writes the rules of a pack as SQL over the window columns *w*.

    With *found*, words are looked up in that column of flags; ``words`` lists them in its order.
    """

    def __init__(self, w: dict[str, str], dialect: Dialect = SPARK, found: Found | None = None):
        self.w, self.d, self.found = w, dialect, found

    def like(self, window: str, pattern: str) -> str:
        test = self.d.like.format(c=self.w[window], p=self.d.quote(regex(pattern)))
        word = anchor(pattern) if self.d.shortcuts else ""
        return f"({self.contains(window, word)} AND {test})" if word else test

    def contains(self, window: str, text: str) -> str:
        test = f"contains({self.w[window]}, {self.d.quote(text)})"
        if self.found is None:
            return test
        flag = self.found.flag(text)  # a window is part of the text
        return flag if window == "text" else f"({flag} AND {test})"

    def group(self, r: Rule, number: int) -> str:
        return f"regexp_extract({self.w[r.window]}, {self.d.quote(regex(r.patterns[0]))}, {number})"

    def any_of(self, tests: Sequence[str]) -> str:
        return "(" + " OR ".join(tests) + ")"

    def condition(self, r: Rule) -> str:
        tests = [self.contains(*split_window(t)) for t in r.has]
        tests += ["NOT " + self.contains(*split_window(t)) for t in r.lacks]
        if r.has_any:
            tests.append(self.any_of([self.contains(*split_window(t)) for t in r.has_any]))
        if r.patterns:
            tests.append(self.any_of([self.like(r.window, p) for p in r.patterns]))
        if r.lacks_pattern:
            tests.append("NOT " + self.like(*r.lacks_pattern))
        if r.group_has:
            tests.append(f"contains({self.group(r, 1)}, {self.d.quote(r.group_has)})")
        if r.group_filled:
            tests.append(f"{self.group(r, 1)} <> ''")
        return " AND ".join(tests)

    def amount(self, source: str) -> str:
        if source in ("total", "first_two"):
            every = self.d.every.format(c=self.w["text"], p=self.d.quote(AMOUNT))
            return getattr(self.d, source).format(a=every)
        window, pattern, number = AMOUNTS[source]
        column = self.w.get(window)
        if window == "after_award":
            column = f"substr({self.w['text']}, greatest(instr({self.w['text']}, 'award'), 1), 100)"
        found = f"nullif(regexp_extract({column}, {self.d.quote(pattern)}, {number}), '')"
        if window == "after_award":
            return f"CASE WHEN {self.contains('text', 'award')} THEN {found} END"
        return found

    def fill(self, r: Rule) -> str:
        pieces = []
        for kind, piece in label_parts(r.label):
            if kind == "text":
                pieces.append(self.d.quote(piece))
            elif piece == "amt":
                pieces.append(self.amount(r.amount))
            else:
                group = self.group(r, int(piece[0]))
                if piece[1:] == "U":
                    group = f"upper({group})"
                elif piece[1:] == "T":
                    group = self.d.title.format(c=group, p=self.d.quote(r"\p{L}+|[^\p{L}]+"))
                pieces.append(group)
        if r.costs:
            whole = self.group(r, 0)
            pieces.append(f"CASE WHEN contains({whole}, 'with costs') THEN ' with costs' ELSE '' END")
        return pieces[0] if len(pieces) == 1 else "(" + " || ".join(pieces) + ")"

    def outcome(self, r: Rule) -> str:
        """The label of one rule, null when it does not fire (no amount gives null too)."""
        label = self.fill(r)
        if r.amount and r.bare is not None:
            label = f"coalesce({label}, {self.d.quote(r.bare)})"
        return f"CASE WHEN {self.condition(r)} THEN {label} END"

    def block(self, gate: Sequence[str], rules: Sequence[Rule]) -> str:
        first = "coalesce(" + ", ".join([self.outcome(r) for r in rules] + ["NULL"]) + ")"
        if not gate or not self.d.shortcuts:
            return first
        return f"CASE WHEN {self.any_of([self.contains('text', g) for g in gate])} THEN {first} END"


def add_windows(df: DataFrame, prefix: str = "_w_") -> DataFrame:
    """Cut the windows out of the lower-cased text, each in the projection after that of its source.

    The widest window of a side is cut out of the text; the others are ends of it.
    """
    names = window_names(prefix)
    widest = {}
    for name, (side, length, of) in WINDOWS.items():
        if of == "text" and length > WINDOWS.get(widest.get(side), ("", 0))[1]:
            widest[side] = name
    for first in (True, False):
        cuts = {}
        for name, (side, length, of) in WINDOWS.items():
            if (name == widest[side]) == first:
                source = of if first or of != "text" else widest[side]
                cuts[names[name]] = F.expr(f"{side}({names[source]}, {length})")
        df = df.withColumns(cuts)
    return df


def window_names(prefix: str = "_w_") -> dict[str, str]:
    return {name: prefix + name for name in ("text", *WINDOWS)}


Block = tuple[str, Sequence[str], Sequence[Rule]]


def first_match(
    df: DataFrame,
    text: Column,
    blocks: Sequence[Block],
    out: str,
    default: str,
    block_out: str | None = None,
) -> DataFrame:
    """Add *out*: the label of the first rule that fires, *default* when none does.

    With *block_out* the name of the deciding block is added too.
    """
    keep = df.columns
    names, found = window_names(), Found("_w_found")
    sql = RuleSql(names, found=found)
    tests = [(name, sql.block(gate, rules)) for name, gate, rules in blocks]
    df = add_windows(found.add_to(df.withColumn(names["text"], F.lower(text)), names["text"]))
    if block_out is None:
        labels = ", ".join(test for _, test in tests)
        df = compute_once(df, {out: F.expr(f"coalesce({labels}, {quote(default)})")})
        return df.select(*[c for c in keep if c != out], out)
    # label and block name travel in one string so that the cascade is evaluated once
    parts = [f"('{name}|' || {test})" for name, test in tests]
    df = compute_once(df, {"_hit": F.expr(f"coalesce({', '.join(parts)}, {quote('none|' + default)})")})
    return df.withColumns(
        {block_out: F.substring_index("_hit", "|", 1), out: F.expr("substr(_hit, instr(_hit, '|') + 1)")}
    ).select(*keep, out, block_out)


def holds_word(column: str, word: str, found: Found | None = None) -> str:
    return found.flag(word) if found else f"contains({column}, {quote_plain(word)})"


def contains_any(column: str, words: Sequence[str], found: Found | None = None) -> str:
    return "(" + " OR ".join(holds_word(column, w, found) for w in words) + ")"


def quote_plain(text: str) -> str:
    """A literal that any SQL engine reads alike (no backslashes inside)."""
    return f"'{text}'" if "'" not in text else "concat('" + text.replace("'", "', chr(39), '") + "')"


Keyword = str | tuple[str | tuple[str, ...], ...]


def keyword_sql(
    column: str, groups: Sequence[tuple[str, Sequence[Keyword]]], default: str, found: Found | None = None
) -> str:
    """CASE giving the first group of which some keyword occurs in the lower-cased *column* (or is flagged in *found*).

    Of a tuple every part must occur; a part that is a tuple occurs if one of its words does.
    """

    def holds(keyword: Keyword) -> str:
        parts = (keyword,) if isinstance(keyword, str) else keyword
        return "(" + " AND ".join(contains_any(column, [p] if isinstance(p, str) else list(p), found) for p in parts) + ")"

    whens = " ".join(
        f"WHEN {' OR '.join(holds(k) for k in words)} THEN {quote_plain(label)}" for label, words in groups
    )
    return f"CASE {whens} ELSE {quote_plain(default)} END"


def score_sql(column: str, entries: Sequence[tuple[str, int]], found: Found | None = None) -> str:
    """Sum of the weights of the keywords that occur in *column*, or are flagged in *found*."""
    return " + ".join(
        f"CASE WHEN {holds_word(column, word, found)} THEN {weight} ELSE 0 END"
        for word, weight in entries
    )


def pattern_label(text: Column, groups: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first (pattern, label) pair whose pattern is found in *text*."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(label)) for p, label in groups], F.lit(default))
