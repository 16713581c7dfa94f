"""The case table in a relational database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "legal_cases"

# Source column, table column and SQL type.
COLUMNS = (
    ("case_id", "case_id", "VARCHAR(64)"),
    ("case_name", "case_name", "VARCHAR(512)"),
    ("source_folder", "source_folder", "VARCHAR(128)"),
    ("year", "year", "VARCHAR(8)"),
    ("court", "court", "VARCHAR(256)"),
    ("case_text", "case_text", None),
    ("case_text_full_length", "case_text_length", None),
    ("verdict", "verdict", "VARCHAR(128)"),
    ("case_type", "case_type", "VARCHAR(64)"),
    ("sub_type", "sub_type", "VARCHAR(64)"),
    ("verdict_mapped", "verdict_mapped", "VARCHAR(32)"),
    ("case_type_mapped", "case_type_mapped", "VARCHAR(32)"),
    ("sub_type_mapped", "sub_type_mapped", "VARCHAR(64)"),
    ("num_citations", "num_citations", None),
    ("legal_citations", "legal_citations", None),
    ("statutes", "statutes", None),
    ("text_length", "text_length", None),
    ("word_count", "word_count", None),
    ("year_numeric", "year_numeric", None),
)


def table_rows(df: DataFrame) -> DataFrame:
    """The columns the table has, under their table names, with the load time."""
    present = [F.col(source).alias(target) for source, target, _ in COLUMNS if source in df.columns]
    return df.select(*present).withColumn("created_at", F.current_timestamp())


def column_types(df: DataFrame) -> str:
    typed = [f"{target} {kind}" for source, target, kind in COLUMNS if kind and source in df.columns]
    return ", ".join(typed)


def bulk_load(
    df: DataFrame,
    url: str,
    properties: Mapping[str, str] | None = None,
    batch_size: int = 500,
    connections: int = 16,
    mode: str = "append",
) -> None:
    """Insert in batches over a bounded number of connections. A failed batch raises.

    The rows are dealt to the writers by a shuffle, so that what computes them keeps its own tasks.
    """
    writer = (
        table_rows(df)
        .repartition(connections)
        .write.format("jdbc")
        .options(url=url, dbtable=TABLE, batchsize=batch_size, **(properties or {}))
    )
    if mode == "overwrite":
        writer = writer.option("createTableColumnTypes", column_types(df))
    writer.mode(mode).save()


def read_all(
    spark: SparkSession, url: str, properties: Mapping[str, str] | None = None, partitions: int = 1
) -> DataFrame:
    """The whole table, read over *partitions* connections split by year."""
    options = {"url": url, "dbtable": TABLE, **(properties or {})}
    if partitions > 1:
        options |= {
            "partitionColumn": "year_numeric",
            "lowerBound": "1600",
            "upperBound": "2100",
            "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()


def read_by_id(spark: SparkSession, url: str, case_id: str, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Point read; the equality runs in the database."""
    return read_all(spark, url, properties).filter(F.col("case_id") == case_id).limit(1)


def count_rows(spark: SparkSession, url: str, properties: Mapping[str, str] | None = None) -> int:
    return read_all(spark, url, properties).count()


def run_sql(spark: SparkSession, statement: str, **args) -> DataFrame:
    """A statement with named parameters over the session's views."""
    return spark.sql(statement, args=args)
