import numpy as np
from pyspark.sql import functions as F

from casework.operators import oversample, retrieve


def vectors(spark, n=40, dim=8, copies=10):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(n, dim)).astype("float32")
    data[:copies] = data[0]  # a quarter of all rows are copies of one
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v], "m" if i < 30 else "k") for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, tag string"), data


def brute(data, k, keep=lambda q, r: True):
    scores = np.round(data.astype("float64") @ data.astype("float64").T, 10)
    return {
        (q, r, rank)
        for q in range(len(data))
        for rank, r in enumerate(
            sorted((r for r in range(len(data)) if keep(q, r)), key=lambda r: (-scores[q][r], r))[:k], 1
        )
    }


def got(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


def test_scan_and_tiles_equal_brute_force(spark, monkeypatch):
    df, data = vectors(spark)
    df = df.repartition(3)
    expected = brute(data, 4)
    assert got(retrieve.top_k(df, df, 4)) == expected
    monkeypatch.setattr(retrieve, "BROADCAST_QUERIES", 5)
    monkeypatch.setattr(retrieve, "TILE_ROWS", 9)
    assert got(retrieve.top_k(df, df, 4)) == expected


def test_same_and_skip(spark):
    df, data = vectors(spark)
    tag = lambda i: i < 30
    expected = brute(data, 3, lambda q, r: q != r and tag(q) == tag(r))
    assert got(retrieve.top_k(df, df, 3, same="tag", skip="id")) == expected


def test_small_tiles_do_not_copy_rows_for_every_tile(spark):
    """Rows travel once per block of the other side, and the blocks' sizes do not follow the tiles'."""
    rng = np.random.default_rng(5)
    data = rng.integers(-3, 4, size=(400, 6)).astype("float64")  # whole numbers: many equal scores
    df = spark.createDataFrame([(i, [float(x) for x in v], None if i % 7 == 0 else f"t{i % 3}") for i, v in enumerate(data)], "id long, embedding array<double>, tag string")
    found = retrieve.top_k(df, df, 4, broadcast_queries=0, tile_rows=16)
    assert got(found) == brute(data, 4)
    assert got(retrieve.top_k(df, df, 4, skip="tag", broadcast_queries=0, tile_rows=16)) == brute(data, 4, lambda q, r: (q % 7 and q % 3) != (r % 7 and r % 3) or (q % 7 == 0) != (r % 7 == 0))
    kernel = retrieve.match_tiles(df.withColumn("g", F.lit(1)), df.withColumn("g", F.lit(1)), "g", 4, "ip", None, "query_id long, id long, score double", 16)
    assert kernel.count() == 4 * 400  # k hits for every query and block, not for each of 25 tiles


def test_no_vectors(spark):
    df, _ = vectors(spark)
    blank = df.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert retrieve.top_k(blank, df, 3).count() == 0


def test_smote_rows_lie_between_parents(spark):
    df, data = vectors(spark)
    out = oversample.smote(df, "tag", "id", "embedding", 3).collect()
    assert {t: sum(r.label == t for r in out) for t in "mk"} == {"m": 30, "k": 30}
    for r in out:
        if r.parent is not None:
            x, y = data[int(r.parent)].astype("float64"), data[int(r.neighbour)].astype("float64")
            u = np.dot(np.array(r.embedding) - x, y - x) / np.dot(y - x, y - x)
            assert 0 <= u < 1 and np.allclose(x + u * (y - x), r.embedding, atol=1e-6)
            assert int(r.parent) >= 30 and int(r.neighbour) >= 30 and r.parent != r.neighbour


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([("1", words), ("2", "  "), ("3", "one two"), (None, "x")], "case_id string, case_text string")
    rows = retrieve.chunk(df, size=10, overlap=4).orderBy("case_id", "chunk_index").collect()
    spans = [(r.word_start, r.word_end) for r in rows if r.case_id == "1"]
    assert spans == [(0, 10), (6, 16), (12, 22), (18, 25)]
    assert [r.chunk_id for r in rows if r.case_id != "1"] == ["3_chunk_0000", "unknown_chunk_0000"]


def test_context_and_scores(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.9, 1, "text a", {"case_type": "Torts", "verdict": "V"}), (1, "b", 0.35249, 2, "text b", None)],
        "query_id int, id string, score double, rank int, text string, metadata map<string,string>",
    )
    row = retrieve.format_context(hits).first()
    assert row.context == "[Case 1] ID=a  Score=0.900  Type=Torts  Verdict=V\ntext a\n\n[Case 2] ID=b  Score=0.352\ntext b"
    df = spark.createDataFrame([("what is {context}", ["what was"], "nothing")], "question string, docs array<string>, answer string")
    scored = retrieve.rag_scores(df).first()
    assert (scored.context_precision, scored.answer_relevance) == (0.333, 0.0)


def test_contexts_take_cases_of_the_whole_table(spark, sf):
    from __spark_entry__ import oracle_sql, queries

    head = {r.query_id: r for r in queries()["format_context"](spark, sf).collect()}
    whole = {r.query_id: r for r in queries()["format_context_all"](spark, sf).collect()}
    cases = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert head.keys() == whole.keys()
    changed = [q for q, r in whole.items() if r.context != head[q].context]
    assert changed and all(any(int(x) % cases != int(x) % 150 for x in whole[q].sources.split(",")) for q in changed)
    assert all("% 150" not in oracle_sql()[n] for n in ("format_context_all", "build_prompts_all"))
