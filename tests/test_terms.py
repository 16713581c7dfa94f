"""Terms counted over batches equal those counted word by word."""

import contextlib
import io
import random
from collections import Counter

import pyarrow as pa
import pytest

from casework.operators import features as feat


def _plain(words, low, high):
    runs = [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]
    return sorted(Counter(runs).items(), key=lambda e: e[0].encode())


@pytest.mark.parametrize("alphabet", [["a", "b", "ab", "'", "é", "zz"], ["a", "a b", "b", "\x01", ""]])
@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (1, 3), (2, 3)])
def test_row_terms(alphabet, low, high):
    rng = random.Random(7)
    for _ in range(50):
        lists = [[rng.choice(alphabet) for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(0, 6))]
        got = feat._row_terms(pa.array(lists, pa.list_(pa.string())), low, high).to_pylist()
        assert [[(e["term"], e["tf"]) for e in row] for row in got] == [_plain(words, low, high) for words in lists]


def test_stats_with_null_groups_and_slices(spark):
    rows = [(None if i % 3 == 0 else i % 2, t) for i, t in enumerate(["a b a", "", None, "b É b", "a"] * 5)]
    df = spark.createDataFrame(rows, "g int, t string").coalesce(1)
    spec = feat.TfidfSpec((1, 2))
    got = feat.term_stats(feat.with_terms(df, "t", spec), "g").collect()
    total, docs = Counter(), Counter()
    for g, t in rows:
        for term, tf in _plain((t or "").lower().replace("é", "e").split(), 1, 2):
            total[g, term] += tf
            docs[g, term] += 1
    assert {(r.g, r.term): (r.total, r.df) for r in got} == {k: (total[k], docs[k]) for k in total}


def test_terms_are_summed_before_they_are_rows(spark):
    """Each (document, term) used to be a row of the aggregation."""
    df = spark.createDataFrame([("a b a",)], "t string")
    stats = feat.term_stats(feat.with_terms(df, "t", feat.TfidfSpec()))
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        stats.explain()
    assert "MapInArrow" in plan.getvalue() and "inline(terms" not in plan.getvalue()


def _texts(rng, n):
    words = [f"w{i}" for i in range(30)] + ["É", "it's", "x_1"]
    return [(i, None if i % 17 == 0 else " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("spec", [feat.TfidfSpec((1, 2), 50, 2, 0.9), feat.TfidfSpec((1, 3), 10_000, 1), feat.TfidfSpec((2, 2), 20, 0.05, 30), feat.TfidfSpec((1, 1), 5, 500)])
def test_vocabulary_of_words_is_that_of_all_terms(spark, monkeypatch, spec):
    """Only terms that can be kept are summed by their text; all terms used to be rows of a shuffle."""
    df = spark.createDataFrame(_texts(random.Random(3), 200), "id long, t string").repartition(3)
    words, terms = feat.term_counts(df, "id", "t", spec), feat.with_terms(df, "t", spec)
    want = sorted(map(tuple, feat.vocabulary(terms, spec).collect()))
    summed, plain = [], feat._named_stats
    monkeypatch.setattr(feat, "_named_stats", lambda c, s, keys: summed.append(len(keys)) or plain(c, s, keys))
    monkeypatch.setattr(feat, "WORDS_AT_ONCE", 300)
    assert sorted(map(tuple, feat.vocabulary(words, spec).collect())) == want
    every = feat.term_stats(terms).count()
    assert summed[0] <= every and (spec.max_features > every or summed[0] < 3 * spec.max_features)


def test_hashes_that_terms_share(spark, monkeypatch):
    """Each hash is that of many terms: counts are those of the terms all the same."""
    spec = feat.TfidfSpec((1, 2), 40, 2)
    df = spark.createDataFrame(_texts(random.Random(5), 60), "id long, t string").coalesce(2)
    want = sorted(map(tuple, feat.vocabulary(feat.with_terms(df, "t", spec), spec).collect()))
    words = feat.term_counts(df, "id", "t", spec)
    hashed = feat._run_hashes

    def few(*a):
        row, coded, starts, keys = hashed(*a)
        return row, coded, starts, [k % 100 for k in keys]

    # the tasks take the function's code along, so it is changed where they look it up
    monkeypatch.setattr(feat, "_run_hashes", few)
    lists = words.toArrow()["terms"].combine_chunks()
    row, coded, starts, keys = feat._run_hashes(lists, 1, 2)
    assert len(set(map(int, keys[0])) | set(map(int, keys[1]))) <= 100
    monkeypatch.undo()
    monkeypatch.setattr(feat, "_hash_sums", lambda counted, s, n: spark.createDataFrame([(1, 10**6, 50)], "key long, total long, df long"))
    # a hash that hides the others: fewer terms than asked for reach its count, so every term is counted
    monkeypatch.setattr(feat, "_named_stats", lambda c, s, keys: feat.term_stats(c, spec=s).limit(0))
    one = feat.TfidfSpec((1, 2), 1, 2)
    got = feat.vocabulary(words, one).collect()
    assert [tuple(r)[0] for r in got] == [tuple(r)[0] for r in feat.vocabulary(feat.with_terms(df, "t", one), one).collect()] and len(want) == 40


@pytest.mark.parametrize("spec", [feat.TfidfSpec((1, 2), 60, 2), feat.TfidfSpec((1, 3), 500, 1, sublinear=False)])
def test_vectors_of_words_are_those_of_terms(spark, monkeypatch, spec):
    df = spark.createDataFrame(_texts(random.Random(4), 80), "id long, t string").coalesce(2)
    words, terms = feat.term_counts(df, "id", "t", spec), feat.with_terms(df, "t", spec).select("id", "terms")
    lookup = feat.Lookup(feat.vocabulary(terms, spec))
    got, want = (sorted((r.id, str(r.features)) for r in feat.row_vector(c, lookup, spec).collect()) for c in (words, terms))
    assert got == want
    lists = words.toArrow()["terms"].combine_chunks()
    held = lookup.held.value
    whole = [x.tolist() for x in feat._look_up(lists, held, spec.sublinear, spec.ngrams)]
    monkeypatch.setattr(feat, "WORDS_AT_ONCE", 50)
    assert [x.tolist() for x in feat._look_up(lists, held, spec.sublinear, spec.ngrams)] == whole
    # numbers that would be too long: terms are looked up by their text
    by_text = (*held[:3], 0, *held[4:])
    assert [x.tolist() for x in feat._look_up(lists, by_text, spec.sublinear, spec.ngrams)] == whole


def test_row_terms_are_words(spark):
    """Counted runs of words were many times as large as the text they were stored for."""
    df = spark.createDataFrame([(1, "b a b"), (2, None)], "id long, t string")
    counted = feat.term_counts(df, "id", "t", feat.TfidfSpec())
    assert [r.terms for r in counted.orderBy("id").collect()] == [["b", "a", "b"], []]
    blanks = feat.TfidfSpec((1, 1), token_pattern="[a-z ]+")
    assert [(e.term, e.tf) for e in feat.term_counts(df, "id", "t", blanks).orderBy("id").first().terms] == [("b a b", 1)]


def test_weights_are_made_once_for_their_rows(spark):
    """The rows of exploded weights had a filter that made the weights a second time."""
    spec = feat.TfidfSpec((1, 2), 60, 2)
    df = spark.createDataFrame([*_texts(random.Random(6), 40), (None, "w1 w2 w1 w2"), (3, "w1 w2")], "id long, t string").coalesce(2)
    counted = feat.term_counts(df, "id", "t", spec)
    vocab = feat.vocabulary(counted, spec)
    weighed = feat.weigh(counted, vocab, "id", spec).collect()
    long = feat.long_weights(counted, vocab, "id", spec)
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, long.collect()), key=key) == sorted(((r.id, e.term, e.w) for r in weighed for e in r.weights), key=key)
    plan = feat.tfidf(df, "id", "t", spec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
