"""Periodic runs and the wavelet tree against brute force."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from casework.llm import queries
from casework.llm.periods import WaveletTree, collapse, find_runs, periodic_runs


def runs(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def brute(doc_id, text, plant=True):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    found.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_range_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(500)[:300]
    tree = WaveletTree(values, 9)
    lo = rng.integers(0, 300, 2000)
    hi = np.minimum(lo + rng.integers(0, 60, 2000), 300)
    least = rng.integers(0, 530, 2000)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least)]
    assert tree.successor(lo, hi, least).tolist() == want


def test_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters, text = "abcdefghij"[: rng.choice([1, 2, 3, 10])], []
            while len(text) < rng.randint(0, 150):
                part = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
                text += (part * rng.randint(1, 7))[: rng.randint(1, 60)]
            texts.append([w.encode() for w in text])
        got = collapse(texts)
        for text, row in zip(texts, got):
            assert tuple(row) == brute(None, b" ".join(text).decode(), plant=False)[1:]


def test_fibonacci_words_and_one_word():
    a, b = ["x"], ["y"]
    for _ in range(11):
        a, b = b, a + b
    for text in (b, ["z"] * 700, (["p", "q", "r"] * 90) + ["p"] + ["q", "r", "p"] * 40):
        assert tuple(collapse([[w.encode() for w in text]])[0]) == brute(None, " ".join(text), plant=False)[1:]


def test_long_text_is_linear():
    words = np.tile(np.arange(1, 5001, dtype=np.uint64), 60)
    start, length, period = find_runs(words, np.array([len(words)]))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [5000])


def test_edges(spark):
    rows = [(i, "one two three " * (i % 7) + "end") for i in range(60)] + [(None, "a b " * 9), (None, None), (3, ""), (10, "x " * 5), (10, "x " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    got = [tuple(r) for r in periodic_runs(docs, plant=True).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted((brute(*r) for r in rows), key=key)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = {r.doc_id: brute(r.doc_id, r.text) for r in docs if len(r.text or "") < 8000}
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and {i: got[i] for i in short} == short
