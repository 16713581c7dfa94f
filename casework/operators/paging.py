"""Pages of a large table, deep ones included, without sorting it for every request.

``write_page_table`` sorts a table once into ranges of its key, numbers the rows inside each
range and notes how many there are. A page then reads the one or two ranges that hold its
rows, and brings only those rows to the driver, however deep it lies. ``page_of`` is for
the first pages of a filtered result; its work grows with the page number.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, MapType, StructType, VariantType

RANGE, ROW = "_page_range", "_page_row"
_HASH, _SALT = "_page_hash", "_page_salt"
RANGE_ROWS = 100_000
SMALL_RANGES = 256  # ranges of fewer rows than that; a file and a task each


def _hashable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def write_page_table(df: DataFrame, path: str, key: str = "case_id", range_rows: int = RANGE_ROWS) -> None:
    """Write *df* under *path*, sorted by *key* (nulls first), with an index of about *range_rows* rows a range.

    Where that would make over ``SMALL_RANGES`` ranges they get larger, up to ``RANGE_ROWS`` rows each.

    Rows of one key are ordered by a digest of their columns; a key of very many rows fills several
    ranges, and so do equal rows. *df* is a stored table: a task that is run again has to meet its
    rows in the same order. An empty table has no pages.
    """
    taken = {RANGE, ROW, _HASH, _SALT} & set(df.columns)
    if taken:
        raise ValueError(f"columns kept for paging: {sorted(taken)}")
    if range_rows < 1:
        raise ValueError("a range has at least one row")
    spark = df.sparkSession
    df.limit(0).write.parquet(f"{path}/schema")
    n = df.count()
    ranges = max(1, min(ceil(n / range_rows), max(SMALL_RANGES, ceil(n / RANGE_ROWS))))
    digest = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)])
    order = [key, _HASH, _SALT]
    rows = df.withColumns({_HASH: digest, _SALT: F.rand(0)}).repartitionByRange(ranges, *order)
    rows = rows.withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *order)
    # the lower 33 bits of the id count the rows of a task, that is of a range
    rows = rows.withColumn(ROW, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows.drop(_HASH, _SALT).write.partitionBy(RANGE).parquet(f"{path}/rows")

    counts = _rows(spark, path).groupBy(RANGE).agg(F.count("*").alias("n"))
    before = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)  # one row per range
    counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema.add(ROW, LongType()).add(RANGE, IntegerType())).parquet(f"{path}/rows")


def _between(spark: SparkSession, path: str, first: int, size: int) -> DataFrame:
    """Rows number *first* to *first* + *size* - 1, in order."""
    index = spark.read.schema(f"{RANGE} int, n long, start long").parquet(f"{path}/ranges")
    # at most *size* ranges, because each has a row
    held = index.filter((F.col("start") < first + size) & (F.col("start") + F.col("n") > first)).collect()
    rows = _rows(spark, path)
    tests = [
        (F.col(RANGE) == r[RANGE]) & F.col(ROW).between(max(0, first - r["start"]), first + size - 1 - r["start"])
        for r in held
    ]
    found = rows.filter(F.lit(False))
    if tests:
        found = rows.filter(tests[0])
        for test in tests[1:]:
            found = found.unionByName(rows.filter(test))
    return found.orderBy(RANGE, ROW).limit(size).drop(RANGE, ROW)


def read_page(spark: SparkSession, path: str, page: int = 1, size: int = 20) -> DataFrame:
    """One page of a page table; none of its rows lie beyond the end."""
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1, size lies between 1 and 100")
    return _between(spark, path, (page - 1) * size, size)


def page_totals(spark: SparkSession, path: str, size: int = 20) -> DataFrame:
    """One row: total rows and pages, from the index alone."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    index = spark.read.schema(f"{RANGE} int, n long, start long").parquet(f"{path}/ranges")
    return index.agg(total.alias("total"), F.ceil(total / F.lit(size)).cast("bigint").alias("pages"))


def page_after(df: DataFrame, last: object | None, size: int = 20, key: str = "case_id") -> DataFrame:
    """The *size* rows after key *last* in key order, from the start when it is None.

    For unique keys without nulls, the keyset form of paging: the comparison reaches the scan,
    which skips files and row groups of a sorted table, and no earlier row is counted off.
    """
    if not 1 <= size <= 100:
        raise ValueError("size lies between 1 and 100")
    rows = df.filter(F.col(key).isNotNull() if last is None else F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(size)
