"""Resumable processing: the committed output says what is done; streams of files and of file pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from casework.sources.case_files import file_sides


class Ledger:
    """Finished keys as an append-only Parquet table; keys are kept as text.

    The key is (source_folder, stem) joined, because four-digit case ids repeat
    between files.
    """

    SCHEMA = StructType([StructField("key", StringType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.SCHEMA)

    def remaining(self, cases: DataFrame, *keys: str) -> DataFrame:
        """Rows whose key is not in the ledger."""
        keyed = cases.withColumn("_key", self.key(*keys))
        done = self.load().distinct().withColumnRenamed("key", "_key")
        return keyed.join(done, "_key", "left_anti").drop("_key")

    @staticmethod
    def key(*keys: str):
        return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])

    def mark_done(self, cases: DataFrame, *keys: str) -> None:
        cases.select(self.key(*keys).alias("key")).write.mode("append").parquet(self.path)

    def is_done(self, key: object) -> bool:
        return not self.load().filter(F.col("key") == str(key)).isEmpty()

    def reset(self) -> None:
        self.spark.createDataFrame([], self.SCHEMA).write.mode("overwrite").parquet(self.path)

    def __len__(self) -> int:
        return self.load().distinct().count()

    def stats(self) -> dict[str, object]:
        return {"completed_cases": len(self), "ledger": self.path}


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at *path*, without rows if there is nothing yet; other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def resume_batch(
    raw: DataFrame,
    ledger: Ledger,
    process: Callable[[DataFrame], DataFrame],
    output: str,
    *keys: str,
) -> DataFrame:
    """Process what is neither in *output* nor in the ledger, append it to *output*; returns the whole output.

    The committed output decides what is done, so nothing is doubled if a run is lost between the output and
    the ledger, which then only repeats what the output holds. Rows that *process* leaves out stay open.
    *process* must keep the key columns.
    """
    spark = raw.sparkSession
    todo = ledger.remaining(raw, *keys)
    fields = StructType([raw.schema[k] for k in keys])
    done = read_or_empty(spark, output, fields).select(Ledger.key(*keys).alias("key"))
    todo = todo.withColumn("key", Ledger.key(*keys)).join(done.distinct(), "key", "left_anti").drop("key")
    if not todo.isEmpty():
        processed = process(todo)
        missing = [k for k in keys if k not in processed.columns]
        if missing:
            raise ValueError(f"process must keep the key columns; {missing} are missing")
        processed.write.mode("append").parquet(output)
    written = read_or_empty(spark, output, fields)
    fresh = ledger.remaining(written.distinct(), *keys)
    ledger.mark_done(fresh, *keys)
    return spark.read.parquet(output)


def stream_cases(
    spark: SparkSession,
    schema: StructType,
    source: str,
    output: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
) -> None:
    """Process the Parquet files that arrived since the last call, then stop.

    The stream's checkpoint remembers finished files. Each batch writes its own
    folder with overwrite, so a batch replayed after a failure does not double.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
PAIR = "source string, stem string, html string, json string"
HALF = "html string, json string"


def pair_sides(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """A row once both sides of a case have arrived; until then the state holds the side that has."""
    html, json = state.get if state.exists else (None, None)
    for rows in batches:
        for kind, content in zip(rows["kind"], rows["content"]):
            html, json = (content, json) if kind == "html" else (html, content)
    if html is None or json is None:
        state.update((html, json))
        return
    if state.exists:
        state.remove()
    yield pd.DataFrame([(*key, html, json)], columns=["source", "stem", "html", "json"])


def stream_case_files(
    spark: SparkSession,
    root: str,
    output: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    files_per_batch: int = 1000,
) -> None:
    """Process the case files below *root* that arrived since the last call, then stop.

    A page and its sidecar may arrive in different calls: the side that comes first waits in the stream's
    state, and the pair is processed when it is whole, once. A file that comes again waits for its other
    side again. Each batch writes its own folder with overwrite, so a replayed batch does not double.
    """

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    reader = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    sides = file_sides(reader.load(f"{root.rstrip('/')}/*/{{html,json}}"))
    pairs = sides.groupBy("source", "stem").applyInPandasWithState(pair_sides, PAIR, HALF, "append", "NoTimeout")
    writer = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    # Every batch lists its files, by default in a task each, by the settings of the session that made the reader.
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(4 * spark.sparkContext.defaultParallelism))
    try:
        writer.start().awaitTermination()
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)
