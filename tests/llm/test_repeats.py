"""Removal of repeated strings against brute force."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from casework.llm import queries, repeats
from casework.llm.repeats import LENGTH, remove_repeats


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if count[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\x01" * LENGTH
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (60, 80, 150, 400)]
    texts = ["", None, "x" * 399, "y" * 400, "y" * 401, "z" * 1500, "ab" * 700, prose(300)]
    for k in range(40):
        p = passages[k % 4]
        cut = p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)]
        texts.append(prose(rng.randint(0, 60)) + cut + prose(rng.randint(0, 60)))
    texts += [texts[10], texts[10], prose(100) + passages[3] + prose(20) + passages[3]]
    texts += [passages[2][:400], passages[2][1:400] + "!", passages[2][:399]]
    copy = list(passages[3])
    for _ in range(3):
        copy[rng.randrange(len(copy))] = "#"
    return [*texts, "".join(copy)]


def test_as_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_edges(spark):
    long = " ".join(str(i * i) for i in range(200))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long + "end"), (None, None), (2, "other")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs).collect())
    n = len(long)
    assert got == sorted([(n, n, 1), (n, n, 1), (n + 3, n, 1), (0, 0, 0), (5, 0, 0)])
    assert remove_repeats(docs.limit(0)).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op2_repeated_strings"](spark, sf).collect()}
    assert [got[r.doc_id] for r in docs] == brute([r.text for r in docs])


def test_crowded_cores(spark, monkeypatch):
    """The passes over all tasks give what the passes in one task give."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(repeats, "GROUP", 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_rows_without_ids_are_linear(spark):
    """2,000 rows without an id, different texts and copies: no id joins them with each other."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600))
    texts = [f"{i} " + "".join(rng.choice("abcdefgh ") for _ in range(450)) + (passage if i % 9 == 0 else "") for i in range(1500)]
    texts += ["one and the same " * 40] * 500
    docs = spark.createDataFrame([(None if i % 2 else 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect())
    assert got == sorted(brute(texts))
