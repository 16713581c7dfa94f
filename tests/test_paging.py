"""Page tables: order, hot keys, equal rows, ends, and how little a deep page reads."""

import pytest
from pyspark.sql import functions as F

from casework.operators import paging
from casework.session import scratch_path


def every_row(spark, path, size):
    pages = paging.page_totals(spark, path, size).first().pages
    return [tuple(r) for p in range(1, pages + 1) for r in paging.read_page(spark, path, p, size).collect()]


def test_every_page_in_order(spark):
    df = spark.range(977).select(F.format_string("case %05d", (F.col("id") * 577) % 977).alias("case_id"), "id")
    path = scratch_path(spark, "pages")
    paging.write_page_table(df, path, range_rows=100)
    assert every_row(spark, path, 100) == [tuple(r) for r in df.orderBy("case_id").collect()]
    assert paging.read_page(spark, path, 49, 20).count() == 17
    assert paging.read_page(spark, path, 50, 20).count() == 0


def test_hot_key_null_keys_and_equal_rows_fill_several_ranges(spark):
    hot = spark.range(600).select(F.lit("hot").alias("case_id"), F.col("id").alias("n"), F.create_map(F.lit("a"), "id").alias("m"))
    equal = spark.range(600).select(F.lit("same").alias("case_id"), F.lit(1).cast("long").alias("n"), F.create_map(F.lit("a"), F.lit(2).cast("long")).alias("m"))
    null = spark.range(7).select(F.lit(None).cast("string").alias("case_id"), F.col("id").alias("n"), F.create_map(F.lit("a"), "id").alias("m"))
    stored = scratch_path(spark, "rows")
    hot.unionByName(equal).unionByName(null).write.parquet(stored)
    df, path = spark.read.parquet(stored), scratch_path(spark, "pages")
    paging.write_page_table(df, path, range_rows=100)
    ranges = spark.read.parquet(path + "/ranges").collect()
    assert sum(r.n for r in ranges) == 1207 and max(r.n for r in ranges) < 400
    rows = [(r.case_id, r.n) for p in range(1, 14) for r in paging.read_page(spark, path, p, 100).collect()]
    assert [k for k, _ in rows] == [None] * 7 + ["hot"] * 600 + ["same"] * 600
    assert sorted(n for k, n in rows if k == "hot") == list(range(600))


def test_deep_page_reads_one_range(spark):
    path = scratch_path(spark, "pages")
    paging.write_page_table(spark.range(20_000).withColumnRenamed("id", "case_id"), path, range_rows=1000)
    page = paging.read_page(spark, path, 900, 20)
    assert [r.case_id for r in page.collect()] == list(range(17_980, 18_000))
    assert len({f.rsplit("/", 1)[0] for f in page.inputFiles()}) <= 20
    plan = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_page_range" in plan and "PushedFilters: [IsNotNull(_page_row)" in plan


def test_small_ranges_grow_before_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(paging, "SMALL_RANGES", 8)
    path = scratch_path(spark, "pages")
    paging.write_page_table(spark.range(2_000).withColumnRenamed("id", "case_id"), path, range_rows=10)
    assert spark.read.parquet(path + "/ranges").count() <= 8
    assert every_row(spark, path, 100) == [(i,) for i in range(2_000)]


def test_empty_table_and_wrong_arguments(spark):
    df, path = spark.createDataFrame([], "case_id string, n int"), scratch_path(spark, "pages")
    paging.write_page_table(df, path)
    assert paging.read_page(spark, path, 1).collect() == []
    assert tuple(paging.page_totals(spark, path).first()) == (0, 0)
    for page, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            paging.read_page(spark, path, page, size)
    with pytest.raises(ValueError):
        paging.write_page_table(df.withColumn("_page_row", F.lit(1)), scratch_path(spark, "pages"))


def test_pages_by_last_key(spark):
    df, last, seen = spark.range(95).withColumnRenamed("id", "case_id"), None, []
    while rows := paging.page_after(df, last, 20).collect():
        seen += [r.case_id for r in rows]
        last = seen[-1]
    assert seen == list(range(95))
