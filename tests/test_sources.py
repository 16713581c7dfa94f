import pytest
import json

from pyspark.sql import functions as F

from casework.operators.quality import passed, validate
from casework.plans.case_table import clean_cases, process_cases, split_clean_unknown
from casework.schemas import CASE
from casework.sources import case_files, jdbc, tables
from casework.streaming.resume import Ledger, resume_batch


def make_files(root):
    for source, stems in {"src1": ["a_0001", "a_0002", "only"], ".hidden": ["x"], "processed_data": ["y"]}.items():
        for kind in ("html", "json"):
            (root / source / kind).mkdir(parents=True)
        for stem in stems:
            (root / source / "html" / f"{stem}.html").write_text(f"<p>Smith v. Jones. the judgment is affirmed. {stem}</p>")
            if stem != "only":
                body = {"name": "", "decision_date": "1901-02-03", "cites_to": ["7 Ind. 200"]}
                (root / source / "json" / f"{stem}.json").write_text(json.dumps(body))
    (root / "src1" / "json" / "lonely.json").write_text("{}")
    (root / "src1" / "html" / "a_0003.html").write_text("<script>x</script>")
    (root / "src1" / "json" / "a_0003.json").write_text("{}")


def test_discovery_to_case_table(spark, tmp_path):
    make_files(tmp_path)
    raw = case_files.discover_cases(spark, str(tmp_path))
    assert {r.stem for r in raw.collect()} == {"a_0001", "a_0002", "a_0003"}
    lost = {(r.stem, r.side) for r in case_files.unmatched_files(spark, str(tmp_path)).collect()}
    assert lost == {("only", "html"), ("lonely", "json")}
    cases = process_cases(raw)
    assert cases.columns == CASE.fieldNames()
    rows = cases.orderBy("case_id").collect()
    assert [r.case_id for r in rows] == ["0001", "0002"]
    assert (rows[0].case_name, rows[0].year, rows[0].verdict) == ("Smith v. Jones", "1901", "Judgment AFFIRMED")
    assert rows[0].legal_citations == "7 Ind. 200"
    clean, unknown = split_clean_unknown(clean_cases(cases))
    assert clean.count() + unknown.count() == 2


def test_master_metadata(spark, tmp_path):
    path = tmp_path / "all_metadata.json"
    path.write_text(json.dumps([{"id": "0001", "name": "n"}, {"id": "9", "name": "stem2"}, {"id": "0001", "name": "late"}]))
    cases = spark.createDataFrame([("0001", "stem1"), ("0002", "stem2"), ("0003", "s3")], "case_id string, stem string")
    out = case_files.attach_master_metadata(cases, case_files.read_master_metadata(spark, str(path))).collect()
    found = {r.case_id: r.metadata for r in out}
    assert found["0001"]["name"] == "late" and found["0002"]["id"] == "9" and found["0003"] is None


def test_resume(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.range(10).select(F.col("id"), F.lit("s").alias("source"))
    seen = []

    def process(df):
        seen.append(df.count())
        return df

    out = str(tmp_path / "out")
    resume_batch(rows.filter("id < 4"), ledger, process, out, "source", "id")
    assert resume_batch(rows, ledger, process, out, "source", "id").count() == 10
    assert resume_batch(rows, ledger, process, out, "source", "id").count() == 10
    assert seen == [4, 6] and len(ledger) == 10 and ledger.is_done("s/3") and not ledger.is_done("s/99")
    ledger.reset()
    assert len(ledger) == 0


def test_csv_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "quoted", line\nnext'), ("2", None)], "case_id string, case_text string")
    paths = tables.save_outputs(df, str(tmp_path), partition_by=None)
    back = tables.read_cases(spark, paths["csv"], df.schema).orderBy("case_id").collect()
    assert back[0].case_text == 'a "quoted", line\nnext' and back[1].case_text is None


def test_validate_levels(spark):
    good = spark.createDataFrame([(str(i),) for i in range(20)], "case_id string").select(
        "case_id", *[F.lit(v).alias(n) for n, v in {
            "year": "1958", "court": "c", "case_text": "text", "verdict": "Judgment AFFIRMED",
            "legal_citations": "", "case_type": "Torts", "sub_type": "Negligence"}.items()])
    assert passed(validate(good))
    for column in good.columns:
        assert not passed(validate(good.drop(column)))
    assert not passed(validate(good.limit(0)))
    warned = {r.check for r in validate(good.withColumns({"case_id": F.lit("1"), "verdict": F.lit("Verdict Unknown"), "case_text": F.lit(" ")})).filter("level = 'warning'").collect()}
    assert warned == {"empty_text", "duplicate_ids", "verdict_low_coverage"}


def test_jdbc_rows(spark):
    """Only the shape of what is sent; no database is started here."""
    df = spark.createDataFrame([("1", 5, "x")], "case_id string, case_text_full_length int, other string")
    assert jdbc.table_rows(df).columns == ["case_id", "case_text_length", "created_at"]
    assert jdbc.column_types(df) == "case_id VARCHAR(64)"


def test_case_table_keeps_whole_texts_and_citations(spark):
    html = "<p>" + "judgment affirmed and more words " * 1000 + "</p>"
    body = json.dumps({"cites_to": [f"{n} Ind. {n}" for n in range(1, 31)]})
    raw = spark.createDataFrame([("src", "a_0001", html, body)], "source string, stem string, html string, json string")
    whole, cut = process_cases(raw).first(), process_cases(raw, cut_text=True, citation_limit=20).first()
    assert len(whole.case_text) == 33 * 1000 - 1 and len(whole.legal_citations.split("; ")) == whole.num_citations == 30
    assert len(cut.case_text) == 10_000 and len(cut.legal_citations.split("; ")) == 20 and cut.num_citations == 30
    assert clean_cases(process_cases(raw)).first().word_count == 5000


def test_lost_ledger_write_doubles_nothing(spark, tmp_path, monkeypatch):
    rows = spark.range(4).select(F.col("id"), F.lit("s").alias("source"))
    out = str(tmp_path / "out")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    monkeypatch.setattr(Ledger, "mark_done", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        resume_batch(rows, ledger, lambda df: df, out, "source", "id")
    monkeypatch.undo()
    assert resume_batch(rows, ledger, lambda df: df, out, "source", "id").count() == 4 and len(ledger) == 4


def test_skipped_rows_stay_open(spark, tmp_path):
    rows = spark.range(4).select(F.col("id"), F.lit("s").alias("source"))
    out, ledger = str(tmp_path / "out"), Ledger(spark, str(tmp_path / "ledger"))
    assert resume_batch(rows, ledger, lambda df: df.filter("id < 2"), out, "source", "id").count() == 2
    assert not ledger.is_done("s/3")
    assert resume_batch(rows, ledger, lambda df: df, out, "source", "id").count() == 4
    with pytest.raises(ValueError):
        resume_batch(spark.range(9).withColumn("source", F.lit("s")), ledger, lambda df: df.select("id"), out, "source", "id")


def test_sides_that_arrive_apart(spark, tmp_path):
    from casework.streaming.resume import stream_case_files

    root, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def put(kind, stem, content):
        folder = root / "a b" / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{stem}.{kind}").write_text(content)

    def seen():
        stream_case_files(spark, str(root), out, state, lambda df: df)
        return sorted((r.source, r.stem, r.html, r.json) for r in spark.read.parquet(out).collect())

    put("html", "one", "<p>1</p>")
    put("html", "two", "<p>2</p>")
    put("json", "two", "{}")
    assert seen() == [("a b", "two", "<p>2</p>", "{}")]
    put("json", "one", '{"late": 1}')
    both = [("a b", "one", "<p>1</p>", '{"late": 1}'), ("a b", "two", "<p>2</p>", "{}")]
    assert seen() == both and seen() == both


def test_only_the_rules_of_wanted_columns_are_planned(spark):
    from casework.plans.case_table import label_cases
    from casework.schemas import CASE

    page = "<p>Smith v. Jones. indictment for grand larceny. the judgment is affirmed. 12 Conn. 345</p>"
    raw = spark.createDataFrame([("src", "src_0001", page, '{"decision_date": "1871-01-01"}')], "source string, stem string, html string, json string")
    whole = process_cases(raw).first().asDict()
    for columns in (("case_id", "year"), ("sub_type",), ("verdict", "num_citations"), ("case_type", "case_id")):
        assert process_cases(raw, columns=columns).first().asDict() == {c: whole[c] for c in columns}
    plan = process_cases(raw, columns=("case_id", "year"))._jdf.queryExecution().optimizedPlan().toString()
    assert "larceny" not in plan and "curiam" not in plan
    plan = process_cases(raw, columns=("verdict",))._jdf.queryExecution().optimizedPlan().toString()
    assert "curiam" in plan and "larceny" not in plan
    assert process_cases(raw).columns == [f.name for f in CASE.fields]

    texts = process_cases(raw, columns=("case_id", "case_text"))
    every = label_cases(texts).first().asDict()
    for columns in (("sub_type",), ("citations", "verdict"), ("legal_citations",)):
        some = label_cases(texts, columns=columns)
        assert set(some.columns) == {"case_id", "case_text", *columns}
        assert all(some.first()[c] == every[c] for c in columns)
    # a sub-type is found within the type that the row has
    typed = texts.withColumn("case_type", F.lit("Torts - Defamation"))
    assert label_cases(typed, columns=("sub_type",)).first().case_type == "Torts - Defamation"
    with pytest.raises(ValueError):
        label_cases(texts, columns=("court",))
    with pytest.raises(ValueError):
        process_cases(raw, columns=("page",))


def test_yearly_statistics_moves_no_text(spark, sf):
    from __spark_entry__ import queries

    plan = queries()["yearly_statistics"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    before, _, after = plan.partition("Exchange hashpartitioning(_groupingexpression")
    # below the only exchange the texts are read from the documents, above it nothing but counts is left
    assert "documents.parquet" in after and "case_text" not in before and "text#" not in before
    assert "Exchange" not in before.replace("AdaptiveSparkPlan", "")


def test_narrow_rows_are_spread_over_splits_without_row_groups(spark, tmp_path):
    """One row group cut into many splits used to stay one task."""
    from pyspark.sql import functions as F

    from casework.session import spread

    path = str(tmp_path / "one-group")
    spark.range(20_000).withColumn("x", F.md5(F.col("id").cast("string"))).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = spread(rows, narrow=True).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in sizes) < 5_000
