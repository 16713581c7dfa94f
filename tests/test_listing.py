"""A stream of many small files lists them in a few tasks, and leaves the session's settings as they were."""

import os

from casework.streaming import resume


def test_files_are_listed_by_few_tasks(spark, tmp_path):
    for kind in ("html", "json"):
        os.makedirs(tmp_path / f"in/a/{kind}")
        for i in range(40):  # over 32 paths are listed by a job
            (tmp_path / f"in/a/{kind}/c{i}.{kind}").write_text(str(i))
    before, seen = spark.conf.get(resume.LISTING, None), []

    def process(df):
        seen.append(spark.conf.get(resume.LISTING))
        return df

    resume.stream_case_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), process)
    assert set(seen) == {str(4 * spark.sparkContext.defaultParallelism)}
    assert spark.conf.get(resume.LISTING, None) == before
    assert spark.read.parquet(str(tmp_path / "out")).filter("html = json").count() == 40
