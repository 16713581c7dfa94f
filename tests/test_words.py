"""Words found by one pass over a text equal those found one by one; labels do not walk over a text per word."""

import contextlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casework.functions.text import collapse_spaces, is_empty
from casework.functions.words import _Search, collapsed, found_words
from casework.rules import labels

WORDS = ["a b", "ab", "b  c", " a", "c ", " ", "é", "abc", "bca", "aa", "zz"]


def test_search_equals_one_by_one():
    rng = random.Random(1)
    search = _Search(WORDS)
    for _ in range(200):
        texts = ["".join(rng.choice("abc é\x01z") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        assert search.flags(pa.array(texts, pa.string())).tolist() == [[w in t for w in WORDS] for t in texts]


def test_found_words_of_a_column(spark):
    texts = ["murderobbery", "grand jury fee", "", None, "estate"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = ["murder", "robbery", "grand jury", "jury fee", "state"]
    got = [r.f for r in df.select("t", found_words(F.col("t"), words).alias("f")).collect()]
    assert got == [None if t is None else [w in t for w in words] for t in texts]


def test_collapsed_equals_the_expression(spark):
    blanks = [0x9, 0xA, 0xB, 0xC, 0xD, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x202F, 0x205F, 0x3000, 0x200B, 0xFEFF]
    texts = [None, "", "  ", "a  b\n c ", *[f"{chr(c)}x{chr(c)}{chr(c)}y" for c in blanks], *map(chr, blanks)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(collapsed(t).alias("a"), collapse_spaces(t).alias("b"), is_empty(t).alias("e")).collect():
        assert r.a == r.b and r.e == (not r.b)


@pytest.mark.parametrize("label", [labels.with_case_type, lambda df, t: labels.with_sub_type(df, t, "t")])
def test_labels_read_flags(spark, label):
    """Some hundred words each used to be a pass over the text of their own."""
    df = label(spark.createDataFrame([("a writ",)], "t string"), "t")
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    assert "Contains(" not in plan.getvalue()
