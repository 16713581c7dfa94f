"""Files and tables in the folder that the cluster shares."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from casework.session import scratch_path, small_batches  # noqa: F401


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI such as file:/, hdfs:// or s3://, or of an absolute path."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Tables:
    """Intermediate tables of one job, written once and deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job = spark, job
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, f"{self.job}-{name}")
        df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
