"""Top-k search, source mixture and licence scan against plain versions, SQL and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import queries
from casework.llm.licences import TEMPLATES, Matcher, scan_licences, whole_texts
from casework.llm.mixture import leaf_budgets, mix_sources, take_mixture
from casework.llm.topk import Block, top_k
from tests.compare import connect, difference

NAMES = ("op5_source_mixture", "op6_licence_scan", "op9_exact_top_k")


@pytest.mark.parametrize("name", NAMES)
def test_sql(spark, sf, name):
    assert difference(spark, connect(sf), queries.QUERIES[name], queries.SQL[name], sf) is None


def plain_top(ids, vectors, query, own, k):
    scored = [(int(np.dot(v.astype(object), query.astype(object))) if len(v) else 0, int(i)) for i, v in zip(ids, vectors) if i != own]
    return sorted(scored, key=lambda s: (-s[0], s[1]))[:k]


@pytest.mark.parametrize("width,span", [(1, 2), (3, 2), (8, 40), (4, 1 << 40), (5, 0)])
def test_block_is_exact(width, span):
    rng = np.random.default_rng(width)
    for n in (1, 2, 9, 300):
        ids = rng.permutation(n * 3)[:n].astype(np.int64)
        vectors = rng.integers(-span, span + 1, (n, width)).astype(np.int64)
        block = Block(ids, vectors)
        for q in [np.zeros(width, np.int64), *rng.integers(-span, span + 1, (6, width)).astype(np.int64)]:
            assert block.top(q, int(ids[0]), 10) == plain_top(ids, vectors, q, ids[0], 10)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [1.0]), (7, [-0.0001, 0.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df.where("vec_id % 100 = 0"), df, k=3).collect()}
    assert got == {(0, 1): (1, 524288), (0, 2): (1, 524288), (0, 3): (100, 524288), (100, 1): (0, 524288), (100, 2): (1, 524288), (100, 3): (1, 524288)}
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", 10, 1), ("a", "y", 1000, 1), ("b", "z", 100, 1), ("b", "u", 100, 1)]
    leaves = spark.createDataFrame(rows, "a string, b string, tokens long, docs long")
    plan = {(r.a, r.b): r.budget for r in leaf_budgets(leaves, {}, ["a", "b"], 50, 2).collect()}
    # 605 tokens: half to each parent; b can take 302; in a, x is full at 20 and y takes the rest
    assert plan == {("a", "x"): 20, ("a", "y"): 282, ("b", "z"): 151, ("b", "u"): 151}
    short = {(r.a, r.b): r.budget for r in leaf_budgets(leaves, {}, ["a", "b"], 90, 2).collect()}
    # 1089: b is full at 400, so the rest goes to a, where x is full
    assert short == {("a", "x"): 20, ("a", "y"): 669, ("b", "z"): 200, ("b", "u"): 200}
    none = leaf_budgets(leaves, {"a": {"a": 0}}, ["a", "b"], 50, 2).where("a = 'a'").collect()
    assert all(r.budget == 0 for r in none)


def test_mixture_edges(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "hot" if i % 3 else f"s{i % 4}", 5) for i in range(400)]
    rows += [(None, None, None, 1), (7, "x y", None, 1), (7, "x y", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies_of long").withColumn("tokens", F.lit("clash"))
    mixed = mix_sources(docs, {"source": F.col("source")}, {}, 50, 3)
    assert mixed.columns == [*docs.columns, "copies"]
    got = mixed.collect()
    assert len(got) == len(rows)
    n = lambda r: len((r.text or "").split())
    used, total = sum(n(r) * r.copies for r in got), sum(map(n, got))
    assert total * 0.5 - 5 * 31 <= used <= total * 0.5
    assert len({r.copies for r in got if r.doc_id == 7 and r.source is None}) == 1
    taken = take_mixture(docs, mixed)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert mix_sources(docs.limit(0), {"source": F.col("source")}, {}, 50, 3).collect() == []


def test_licences_are_inherited(spark):
    mit, apache = TEMPLATES["MIT"][1], TEMPLATES["Apache-2.0"][0]
    rows = [
        (1, "a/LICENSE", mit),
        (2, "a/b/c/code.txt", "some words only"),
        (3, "a/b/own.txt", f"many words before the header line\n{apache}\n" + "x y z " * 50),
        (4, "a/b/d/LICENSE", apache),
        (5, "a/b/d/e/deep.txt", None),
        (6, "other/file.txt", ""),
        (6, "other/file.txt", ""),
        (7, None, "words"),
        (8, "ab/c.txt", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, where string, text string").withColumn("dir", F.lit("clash"))
    out = scan_licences(docs, F.col("where"))
    got = sorted(((r.doc_id, r.own_licence, r.licence, r.inherited_from) for r in out.collect()), key=str)
    assert got == [
        (1, "MIT", "MIT", None),
        (2, None, "MIT", "a"),
        (3, "Apache-2.0", "Apache-2.0", None),
        (4, "Apache-2.0", "Apache-2.0", None),
        (5, None, "Apache-2.0", "a/b/d"),
        (6, None, None, None),
        (6, None, None, None),
        (7, None, None, None),
        (8, None, None, None),
    ]
    assert scan_licences(docs.limit(0), F.col("where")).collect() == []


def test_every_template_names_itself():
    matcher = Matcher(TEMPLATES, {}, 100)
    for name, texts in TEMPLATES.items():
        for text in texts:
            assert matcher.text(f"intro words\n{text}\nmore")[0] == name
    assert matcher.text("the work of the people under the law")[0] is None


def test_licences_in_wrapped_headers_inline_notices_and_whole_files(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
"""
    apache = TEMPLATES["Apache-2.0"][1]
    whole = whole_texts()
    mit = whole["MIT"].replace("<year> <copyright holders>", "2019 Some Person")
    code = "def run(x):\n    return x + 1\n" * 40
    rows = [
        (1, "wrapped/a.py", gpl.format(3) + code),
        (2, "wrapped/b.py", gpl.format(2) + code),
        (3, "inline/a.txt", f"{'plain words go here ' * 30} {apache} {'and others follow ' * 30}"),
        (4, "mit/LICENSE", mit),
        (5, "mit/src/a.py", code),
        (6, "gpl/COPYING", whole["GPL-3.0"]),
        (7, "bsd/LICENSE", whole["BSD-2-Clause"]),
        (8, "head/a.c", "/* " + whole["MIT"].replace("\n", "\n * ") + " */\n" + code),
        (9, "apache/LICENSE", whole["Apache-2.0"]),
        (10, "none/a.py", code),
    ]
    got = {r.doc_id: r for r in scan_licences(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    own = ["GPL-3.0", "GPL-2.0", "Apache-2.0", "MIT", None, "GPL-3.0", "BSD-2-Clause", "MIT", "Apache-2.0", None]
    assert [got[i].own_licence for i in range(1, 11)] == own
    assert {i for i in got if got[i].licence_file} >= {4, 6, 7, 9}
    assert not got[1].licence_file and not got[3].licence_file
    assert (got[5].licence, got[5].inherited_from) == ("MIT", "mit")


def test_mixture_of_rows_without_distinct_ids(spark, monkeypatch):
    """A leaf whose rows have no id, or one id, is cut between rows, and equal rows go together."""
    from casework.llm import mixture

    monkeypatch.setattr(mixture, "PIECE", 20)
    rows = [(None, f"text {i} of five words") for i in range(3000)] + [(7, f"other {i} of five words") for i in range(3000)]
    rows += [(None, "the same five words here")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    mixed = mixture.mix_sources(docs, {"source": F.col("source")}, {}, budget_percent=50, max_epochs=1)
    out = mixed.groupBy("text").agg(F.min("copies").alias("low"), F.max("copies").alias("high"), F.count("*").alias("n")).collect()
    assert all(r.low == r.high for r in out)
    taken = sum(r.n * r.low for r in out) * 5
    budget = len(rows) * 5 // 2
    assert budget - 2500 - 5 < taken <= budget
