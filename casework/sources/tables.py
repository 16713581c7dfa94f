"""Reading and writing the case table, reports and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from casework.schemas import CASE, VECTOR

CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def read_cases(spark: SparkSession, path: str, schema: StructType = CASE) -> DataFrame:
    """Case table from CSV or Parquet, by the file ending; column names lose outer blanks."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.options(**CSV).schema(schema).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv_stripped(spark: SparkSession, path: str) -> DataFrame:
    """CSV of unknown layout, every column text; header names lose outer blanks."""
    df = spark.read.options(**CSV).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.withColumns({name: F.to_json(F.col(name)) for name in nested}) if nested else df


def save_outputs(df: DataFrame, folder: str, partition_by: str | None = "source_folder") -> dict[str, str]:
    """CSV, JSON and Parquet of one table; Parquet is split by source."""
    paths = {kind: f"{folder.rstrip('/')}/legal_cases_complete.{kind}" for kind in ("csv", "json", "parquet")}
    flat(df).write.mode("overwrite").options(header="true", escape='"', quoteAll="true").csv(paths["csv"])
    df.write.mode("overwrite").json(paths["json"])
    writer = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(paths["parquet"])
    return paths


def save_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """One small result table as one file. Only aggregated frames belong here."""
    writer = flat(df).coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", "true").csv(path)


def export_predictions(df: DataFrame, path: str) -> None:
    df.select("id", "case_type", "sub_type", "verdict", "error").write.mode("overwrite").options(
        header="true", quoteAll="true", escape='"'
    ).csv(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select(*VECTOR.fieldNames()).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR).parquet(path)


def save_splits(splits: DataFrame, path: str) -> None:
    """Train, validation and test rows, one folder each."""
    splits.write.mode("overwrite").partitionBy("split").option("header", "true").csv(path)
