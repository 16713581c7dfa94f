"""Reports over costly columns find those once, and read the stored narrow table after that."""

from pyspark.sql import functions as F

from casework.operators import profile


def test_lists_and_totals_read_the_cases_once(spark):
    rows = [("a", "x", "n", True), ("a", "y", None, True), ("b", "y", "n", True), ("c", "z", "s", False)]
    df = spark.createDataFrame(rows, "case_type_mapped string, verdict_mapped string, court string, is_clean boolean")
    found = profile.corpus_distributions(df)
    assert {f.split("/")[-2].rpartition("-")[0] for f in found.inputFiles()} == {"label-counts"}
    got = {(r.list, r.label): (r.n, r.percent) for r in found.collect()}
    assert got[("case_type", "a")] == (2, 66.67) and got[("court", "n")] == (2, 100.0) and ("verdict", "z") not in got


def test_citation_lists_are_found_once(spark):
    rows = [(["a", "b"],), (["a", "b"],), (["b", "b"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "citation_list array<string>").withColumn("text", F.lit("not kept"))
    found = profile.citation_corpus_stats(df)
    assert {f.split("/")[-2].rpartition("-")[0] for f in found.inputFiles()} == {"citation-lists"}
    got = found.first()
    assert (got.total_citations, got.unique_citations, got.duplicate_lists, got.rows_with_inner_duplicates) == (6, 2, 2, 1)


def test_totals_come_with_the_label_lists(spark):
    """The three lists of the statistics page were left out."""
    columns = "case_type_mapped string, verdict_mapped string, court string, is_clean boolean, num_citations int, year_numeric int"
    rows = [("a", "x", "n", True, 2, 1850), ("a", "y", None, True, 1, None), ("b", "y", "n", True, None, 1860), ("c", "z", "s", False, 9, 1700)]
    df = spark.createDataFrame(rows, columns)
    got = profile.corpus_stats(df).first()
    assert tuple(got)[:6] == (4, 3, 1, 1.5, 1850, 1860)
    assert [tuple(e) for e in got.case_type_dist] == [("a", 2, 66.67), ("b", 1, 33.33)]
    assert [tuple(e) for e in got.verdict_dist] == [("y", 2, 66.67), ("x", 1, 33.33)]
    assert [tuple(e) for e in got.top_courts] == [("n", 2, 100.0)]
    nothing = profile.corpus_stats(df.filter("NOT is_clean")).first()
    assert (nothing.total_cases, nothing.clean_cases, nothing.case_type_dist, nothing.top_courts) == (1, 0, [], [])
