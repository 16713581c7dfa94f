"""Removal of repeated word windows against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

from casework.llm import queries, seeds, substrings
from casework.llm.substrings import LENGTH, remove_substrings


def brute(rows):
    """Rows (id, text) in any order; equal rows count one after the other."""
    digest = lambda t: hashlib.md5(t.encode()).digest()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), [None] * len(rows)
    whole = {}
    for k in order:
        text = rows[k][1] or ""
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - LENGTH + 1):
            window = tuple(words[i : i + LENGTH])
            if window in seen:
                gone[i : i + LENGTH] = [True] * LENGTH
            seen.add(window)
        whole.setdefault(digest(text), k)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[k] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def expected(rows):
    return sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows)))


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "über", "C", "d,", "e"]) + str(rng.randint(0, 30))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (20, 24, 45, 200)]
    texts = [[], ["x"] * 19, ["x"] * 20, ["x"] * 21, ["y"] * 90, ["p", "q", "r"] * 30, prose(19), passages[0]]
    for k in range(120):
        p = passages[k % 4]
        cut = p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        texts.append(prose(rng.randint(0, 30)) + cut + prose(rng.randint(0, 30)))
    for _ in range(30):  # near copies: one word differs here and there
        copy = list(passages[3])
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(len(copy))] = "#"
        texts.append(copy)
    for _ in range(40):  # few words, many equal grams
        texts.append([rng.choice("ab") for _ in range(rng.randint(20, 60))])
    texts += [texts[30], texts[30], passages[3] + passages[3]]
    rng.shuffle(texts)
    return [(i, rng.choice([" ", "\n", "\t "]).join(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_as_brute_force(spark):
    rows = corpus() + [(100_000, None)]
    got = remove_substrings(frame(spark, rows).withColumn("uid", F.lit("clash")).withColumn("h", F.lit(1)))
    assert found(got) == expected(rows)


def test_crowded_seeds(spark, monkeypatch):
    """The ways for crowded groups and for many documents give the same rows."""
    rows = corpus()
    monkeypatch.setattr(substrings, "GROUP", 3)
    monkeypatch.setattr(seeds, "FEW", 0)
    assert found(remove_substrings(frame(spark, rows))) == expected(rows)


def test_edges(spark):
    long = " ".join(str(i * i) for i in range(60))
    rows = [(7, long), (7, long), (None, "new words " + long), (None, None), (2, "other"), (None, long), (9, long + " end"), (None, "z " * 50)]
    assert found(remove_substrings(frame(spark, rows))) == expected(rows)
    assert remove_substrings(frame(spark, rows).limit(0)).collect() == []


def test_one_long_text_and_rows_without_ids(spark):
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(5000)) for _ in range(60_000))
    rows = [(1, long + " " + long[:30_000]), *[(None, long[:5000])] * 500, *[(3, "one two " * 30)] * 300]
    assert found(remove_substrings(frame(spark, rows))) == expected(rows)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert found(queries.QUERIES["op11_substring_dedup"](spark, sf)) == expected([(r.doc_id, r.text) for r in docs])
