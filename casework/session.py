"""Session settings and the small helpers every job shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "casework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``); a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="casework-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, never reused between runs."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write *df* to the shared folder and read it back.

    The written table survives lost executors, so iterative callers (folds,
    repeated fits) do not replay the text rules from the source each time.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_for_now(df: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """As ``cut_lineage``, for a table that nothing reads after the block: it is deleted then."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs that run inside send at most *size* of rows (one row at least) to Python at a time; several long texts are more than they need."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, *keys: str, narrow: bool = False) -> DataFrame:
    """Give CPU-heavy row work enough tasks.

    A few large row groups make a few tasks however many cores there are. Big
    inputs already arrive in more splits than cores and are left alone, so no
    shuffle of the text happens at scale.

    A split without the middle of a row group holds no rows, so that many splits may still be few
    tasks with work. *narrow* rows, cheap to move beside the work on them, are therefore dealt out always.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if narrow:
        return df.repartition(4 * max(cores, df.rdd.getNumPartitions()))
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly *columns* so that later filters and projections reuse their values.

    A plain projection would be copied into every expression above it: a filter on
    a label derived from the verdict would run the cascade once per mention. The
    optimizer does not look through a generator, so a one-element ``inline`` keeps
    the value a value. It stays inside the task; nothing is shuffled.
    """
    kept = [c for c in df.columns if c not in columns]
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(values)))
