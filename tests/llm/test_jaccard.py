"""The similarity join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from casework.llm import jaccard, queries
from casework.llm.arrays import U, shingle_set
from casework.llm.jaccard import COLD, drop_similar, set_key, signatures, similar_documents, sketch, sketch_distance

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """{place: (set size, smallest reachable id)} for (id, text) rows with ids."""
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    ids = {}
    for i in range(len(sets)):
        ids.setdefault(find(i), []).append(texts[i][0])
    return [(texts[i][0], len(sets[i]), min(ids[find(i)])) for i in range(len(sets))]


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = []
    hub = [word() for _ in range(120)]
    for _ in range(3 * COLD):  # one large group of near copies
        copy = list(hub)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(120)] = word()
        texts.append(" ".join(copy))
    passage = [word() for _ in range(60)]
    for _ in range(2 * COLD):  # unlike texts that share a long passage
        texts.append(" ".join([*passage, *[word() for _ in range(rng.randint(10, 60))]]))
    for _ in range(12):  # a chain: each like the next only
        hub = hub[6:] + [word() for _ in range(6)]
        texts.append(" ".join(hub).upper())
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 12, 15, 20, 30):  # short ones with one word more or less
        base = [word() for _ in range(n)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join(base[:-1])]
    texts += [texts[0]] * 40 + ["", None, " \n", "one", "ONE", "one"]
    rng.shuffle(texts)
    return [(rng.randint(0, 10**9) * 1000 + i, t) for i, t in enumerate(texts)]


def test_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("label", F.lit(1))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect())
    assert got == sorted(brute(rows))
    expected = {c for _, n, c in brute(rows) if n} | {i for i, n, _ in brute(rows) if not n}
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)


def test_groups_at_the_border_of_similarity(spark, monkeypatch):
    """Copies of a base whose differences lie about the threshold: many components in one group."""
    monkeypatch.setattr(jaccard, "LEADERS", 4)
    monkeypatch.setattr(jaccard, "GROWTH", 2)
    monkeypatch.setattr(jaccard, "TILE", 300)
    met, meet = [], jaccard._meet
    monkeypatch.setattr(jaccard, "_meet", lambda *a: met.append(meet(*a)) or met[-1])
    rng = random.Random(5)
    base, rows = [f"b{i}" for i in range(90)], []
    for i in range(20 * COLD):
        copy = list(base)
        copy[18 * (i % 5) : 18 * (i % 5) + 14] = [f"v{i % 5}-{j}" for j in range(14)]  # unlike the other variants
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**9) * 100 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect())
    assert got == sorted(brute(rows))
    assert any(not m.isEmpty() for m in met)


def test_edges(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of some words"), (None, "a b c d e f g"), (None, None), (None, "only here one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in similar_documents(docs).collect())))
    assert got == sorted(map(str, [(1, 3, 1), (1, 3, 1), (1, 2, 1), (None, 3, 1), (None, 0, None), (None, 1, None)]))
    assert drop_similar(docs).count() == 5
    assert similar_documents(docs.limit(0)).collect() == []
    assert drop_similar(docs.limit(0)).collect() == []


@pytest.mark.parametrize("size", [3, 4, 6, 9, 13, 20, 40, 100, 400])
def test_linked_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop, add = rng.integers(0, size // 4 + 1), rng.integers(0, size // 3 + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and set_key(a) != set_key(b):
            mine, other = ({(band, int(s)) for band, _, found in signatures(x, 75) for s in found} for x in (a, b))
            assert mine & other
        assert sketch_distance(sketch(a), sketch(b)) <= len(a) + len(b) - 2 * both


def test_sets_are_exact():
    for _, text in corpus():
        assert len(shingle_set(text)) == len(shingles(text))
    assert shingle_set("a b c d").dtype == U


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op1_jaccard_join"](spark, sf).collect())
    assert got == sorted(brute(rows))


def test_near_copies_under_null_and_repeated_ids(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    rows, groups = [], []
    for i in (7, None, None, 8):
        base = [word() for _ in range(60)]
        texts = [" ".join([*base, word()]) for _ in range(2)]
        rows += [(i, t) for t in texts]
        groups.append(texts)
    ends = [word() for _ in range(40)]
    bridge = [" ".join([*ends[n:], *[f"{n}x{j}" for j in range(n)]]) for n in (0, 4)]
    rows += [(9, bridge[0]), (None, bridge[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {}
    for r in jaccard.linked_sets(docs, "doc_id", "text", 5, 75).collect():
        labels[r.k] = r.label
    for texts in [*groups, bridge]:
        assert len({labels[set_key(shingle_set(t))] for t in texts}) == 1
    assert len(set(labels.values())) == 5
    got = similar_documents(docs).where("doc_id IS NULL AND component_id = 9").count()
    assert got == 1
    assert drop_similar(docs).count() == 5


def test_one_of_the_copies_without_ids_stays(spark):
    near = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, "a b c d e f g", n) for n in (3, 1, 2)] + [(None, near, 1), (None, near, 1), (None, None, 1), (None, None, 1), (5, "x y z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(None, "a b c d e f g"), (None, near), (None, None), (None, None), (5, "x y z")], key=str
    )
