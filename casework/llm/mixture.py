"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree, by default domain, language and source. A token budget
is handed down the tree by the weights of the children. A child that cannot use
its share (it can be read ``max_epochs`` times at most) leaves the shortage to its
siblings; what they cannot take either has already been left to the siblings of
the parent, because a parent's capacity is the sum of its children's. Each leaf
then takes whole epochs and, of one more epoch in seeded order, the longest prefix
of documents within its budget.

Scale: the tree is one aggregated row per leaf; budgets are windows over it. The
cut of a leaf is found by descending its order keys three digits at a time over
partial sums, until few documents are left around it or the keys end, so a leaf or an id
with a third of all rows is never sorted in one task; equal keys are summed before they are sorted.
Documents meet their leaf's cut in one join; texts move only if the leaves are
too many to broadcast.

Defined results: a null path value counts as '(none)'; a null or empty text has no
tokens, and documents without tokens follow their place in the order; unlisted
values weigh 1, weights below 1 take nothing; rows of one id, or without one, follow each other
by a digest of their texts, and only rows that are equal in both share a place and are
taken or left together; an empty table gives an empty one. The added column is
named by ``copies_column``; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.session import cut_lineage

NONE = "(none)"
DIGITS = 3  # hexadecimal digits settled by one pass: at most 4096 partial sums for each leaf
PIECE = 4096  # documents that the last pass may leave to one sort


def token_count(text: Column) -> Column:
    """Number of words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    listed = weights.get(level, {})
    if not listed:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(v) for pair in listed.items() for v in pair])
    return F.greatest(F.coalesce(F.element_at(table, F.col(level)), F.lit(1)).cast("long"), F.lit(0).cast("long"))


def _fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Shares *budget* of each parent among its children by weight, none above its capacity.

    Children in the order of capacity by weight: as long as a child's fair part of what is
    left reaches its capacity it is full; all later ones share the rest by weight.
    """
    ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w")).otherwise(F.lit(0.0))
    ordered = Window.partitionBy(*parents).orderBy("ratio", name)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("w").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    df = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("ratio", ratio)
    df = df.withColumn("part", F.when(weight > 0, left.cast("double") / weight).otherwise(F.lit(0.0)))
    full = F.col("ratio") <= F.col("part")
    rest = F.max(F.when(~full, F.col("part"))).over(Window.partitionBy(*parents))
    df = df.withColumn("rest", rest)
    given = F.least(F.col("cap"), F.floor(F.col("w") * F.col("rest")).cast("long"))
    return df.withColumn("given", F.when(full, F.col("cap")).otherwise(given)).drop("ratio", "part", "rest")


def leaf_budgets(
    leaves: DataFrame,
    weights: Mapping[str, Mapping[str, int]],
    path: Sequence[str],
    budget_percent: int,
    max_epochs: int,
) -> DataFrame:
    """Budget, whole epochs and rest of every leaf; *leaves* has the path, tokens and docs."""
    given = None
    for depth in range(1, len(path) + 1):
        nodes = leaves.groupBy(*path[:depth]).agg((F.sum("tokens") * max_epochs).alias("cap"))
        nodes = nodes.withColumn("w", _weight(path[depth - 1], weights))
        if depth == 1:
            # a scalar of the aggregated leaves
            total = leaves.agg(F.floor(F.sum("tokens") * budget_percent / 100).cast("long").alias("t"))
            nodes = nodes.withColumn("budget", F.coalesce(total.scalar(), F.lit(0).cast("long")))
        else:
            nodes = nodes.join(given, list(path[: depth - 1]))
        filled = _fill(nodes, path[: depth - 1] or [F.lit(0)], path[depth - 1])
        given = filled.select(*path[:depth], F.col("given").alias("budget"))
    out = leaves.join(given, list(path))
    out = out.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long"))
    return out.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _order_key(epochs: Column, key: Column, text: Column, seed: int) -> Column:
    """Digest of the id, then of the text: the second decides among rows of one id."""
    first = F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.coalesce(key.cast("string"), F.lit(NONE))))
    return F.concat(first, text)


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


KEY_DIGITS = 64  # of an order key


def mix_sources(
    docs: DataFrame,
    path: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    budget_percent: int = 60,
    max_epochs: int = 4,
    seed: int = 17,
    id_column: str = "doc_id",
    text_column: str = "text",
    copies_column: str = "copies",
) -> DataFrame:
    """All rows with the number of times each is to be read.

    *path* names the levels of the tree from the root down and how to compute each;
    *weights* holds whole-number weights by level and value; the budget is
    *budget_percent* of all tokens.
    """
    levels = [f"_level_{name}" for name in path]
    by_level = {f"_level_{name}": w for name, w in weights.items()}
    steps = {f"_level_{n}": F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in path.items()}
    narrow = docs.select(
        F.col(id_column).alias("_id"),
        token_count(F.col(text_column).cast("string")).alias("_n"),
        _text_key(F.col(text_column)).alias("_t"),
        *[c.alias(n) for n, c in steps.items()],
    )
    narrow = cut_lineage(narrow, "mixture-docs")
    leaves = cut_lineage(
        narrow.groupBy(*levels).agg(F.sum("_n").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixture-leaves"
    )
    plan = cut_lineage(leaf_budgets(leaves, by_level, levels, budget_percent, max_epochs), "mixture-plan")
    cut = plan.select(*levels, "epochs", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for depth in range(KEY_DIGITS // DIGITS):
        keyed = narrow.join(cut, levels).withColumn("h", _order_key(F.col("epochs"), F.col("_id"), F.col("_t"), seed))
        keyed = keyed.where(F.col("h").startswith(F.col("prefix")))
        piece = F.substring("h", depth * DIGITS + 1, DIGITS)
        sums = keyed.groupBy(*levels, "prefix", piece.alias("piece")).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("docs"))
        sums = cut_lineage(sums, "mixture-sums")
        running = F.sum("n").over(Window.partitionBy(*levels).orderBy("piece"))
        found = cut.join(sums, [*levels, "prefix"]).withColumn("upto", F.col("before") + running)
        # the first piece that does not fit; where all fit, one after the last
        first = found.where(F.col("upto") > F.col("rest")).groupBy(*levels).agg(
            F.min(F.struct("piece", (F.col("upto") - F.col("n")).alias("before"), "docs")).alias("at")
        )
        cut = cut.join(first, levels, "left").select(
            *levels,
            "epochs",
            "rest",
            F.concat("prefix", F.coalesce("at.piece", F.lit("g"))).alias("prefix"),
            F.coalesce("at.before", "before").alias("before"),
            F.coalesce("at.docs", F.lit(0)).alias("docs"),
        )
        cut = cut_lineage(cut, "mixture-cut")
        around = cut.agg(F.max("docs")).first()[0] or 0
        cut = cut.drop("docs")
        if around <= PIECE:
            break
    keyed = narrow.join(cut, levels).withColumn("h", _order_key(F.col("epochs"), F.col("_id"), F.col("_t"), seed))
    inside = keyed.where(F.col("h").startswith(F.col("prefix")))
    inside = inside.groupBy(*levels, "h", "before", "rest").agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy(*levels).orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("upto", F.col("before") + F.sum("_n").over(order)).where(F.col("upto") <= F.col("rest"))
    last = fits.groupBy(*levels).agg(F.max("h").alias("last"))
    bounds = cut.join(last, levels, "left").select(*levels, "epochs", F.coalesce("last", "prefix").alias("last"))
    bounds = cut_lineage(bounds, "mixture-bounds")
    places = docs.withColumns(steps).join(bounds, levels)
    key = _order_key(F.col("epochs"), F.col(id_column), _text_key(F.col(text_column)), seed)
    taken = (key <= F.col("last")).cast("long")
    return places.select(*docs.columns, (F.col("epochs") + taken).alias(copies_column))


def take_mixture(docs: DataFrame, mixed: DataFrame, copies_column: str = "copies") -> DataFrame:
    """The documents as often as the mixture reads them, in the columns of *docs*."""
    times = F.sequence(F.lit(1).cast("long"), F.col(copies_column))
    chosen = mixed.where(F.col(copies_column) > 0).withColumn("_time", F.explode(times))
    return chosen.select(*docs.columns)
