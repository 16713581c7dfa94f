"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from casework.llm import queries, variants
from casework.llm.variants import spelling_variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    n = counts(rows)
    out, form = {}, {}
    for w in n:
        close = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, letters, sizes, n_words):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n_words)]
    text = []
    for w in base:
        text += [w] * rng.randint(3, 40)
        for _ in range(rng.randint(0, 6)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]])
            text += [v] * rng.randint(1, 9)
    rng.shuffle(text)
    return [(k, " ".join(text[k::25])) for k in range(25)]


def test_as_brute_force(spark):
    rows = corpus(2, "abAéÿ", [4, 5, 6, 7], 60) + corpus(3, "ab", [5, 6, 8], 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prefix", F.lit("clash"))
    assert found(spelling_variants(docs)) == brute(rows)


def test_long_words(spark, monkeypatch):
    """Prefixes that travel as hashes, and those around the limit."""
    rows = corpus(4, "ab", [63, 64, 65, 66, 90], 40) + corpus(5, "ab", [5, 6], 10)
    assert found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    monkeypatch.setattr(variants, "ROTATIONS", 7)
    monkeypatch.setattr(variants, "HELD", 3)
    assert found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rotations_of_long_words_are_those_of_short_ones(monkeypatch):
    groups = lambda words: sorted(
        sorted((w, c, f) for w, c, f in members) for members in by_prefix(words).values()
    )

    def by_prefix(words):
        out = {}
        for w in words:
            for key, c, f in variants.rotations(w):
                out.setdefault(key, []).append((w, c, f))
        return out

    words = ["aabba", "aabb", "abba", "aabbab", "aaaaa", "aaaa", "xaabb"]
    short = groups(words)
    monkeypatch.setattr(variants, "LONG", 3)
    assert groups(words) == short


def test_edges(spark):
    long = "a" * 30_000
    rows = [(1, f"{long} {long} {long} {long}b {long}b {long}b {long}b {long}b {long}b"), (None, None), (2, ""), (3, "ÀÉÎÕÜ×÷ " * 4), (None, "colour color " * 5), (None, "colour " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = counts(rows)
    got = {r[0]: tuple(r) for r in found(spelling_variants(docs))}
    assert {w: r[3] for w, r in got.items()} == want
    assert got[long][1:] == (long + "b", long + "b", 3, 1, 6)
    assert got["color"][1:] == ("colour", "colour", 5, 1, 10) or "color" not in want
    assert spelling_variants(docs.limit(0)).collect() == []


def test_chains_of_forms(spark):
    names = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb", "bbbbbb", "bbbbbc"]
    text = " ".join(w for k, w in enumerate(names) for _ in range(3 * 2**k))
    rows = [(5, text)]
    assert found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
