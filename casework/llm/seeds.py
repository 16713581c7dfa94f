"""How texts meet on seeds: what operators that look for repeated strings have in common.

A scan hands on the occurrences of its seeds: h, the seed; w, a hash of all that windows around it
span; id, uid and p, where it stands. Counts and first places are aggregated before they move, and
a seed in a third of all texts meets them in joins that split skewed keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.shared import Tables

PLACE = ("id", "uid", "p")  # in the order of documents
FEW = 500_000  # document keys that may be broadcast
LAST = (1 << 63) - 1


def raw_bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def keyed_texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, no_id, text, d): rows without an id come last; d is the text's MD5."""
    key = docs[id_column].cast("long")
    text = F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text")
    texts = docs.select(F.coalesce(key, F.lit(LAST)).alias("id"), key.isNull().alias("no_id"), text)
    return texts.withColumn("d", F.unhex(F.md5(F.col("text").cast("binary"))))


def meet(tables: Tables, occurrences: DataFrame) -> DataFrame:
    """(h, id, uid, p, first, alike, kinds) of the occurrences of repeated seeds.

    *first*: the earliest with its w; *alike*: occurrences with that w; *kinds*: different w of the seed.
    """
    seeds = tables.keep("seeds", occurrences.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = tables.keep("again", occurrences.join(seeds.select("h"), "h", "left_semi"))
    tables.drop("seeds")
    firsts = tables.keep("firsts", again.groupBy("h", "w").agg(F.min(F.struct(*PLACE)).alias("least"), F.count(F.lit(1)).alias("alike")))
    kinds = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    firsts = tables.keep("kinds", firsts.join(kinds, "h"))
    met = again.join(firsts, ["h", "w"])
    met = tables.keep("met", met.select("h", *PLACE, (F.struct(*PLACE) == F.col("least")).alias("first"), "alike", "kinds"))
    tables.drop("again", "firsts", "kinds")
    return met


def bring(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """*wanted* (id, d and more) with the text of each row; of equal rows one gives its text."""
    if wanted.count() <= FEW:
        texts = texts.join(F.broadcast(wanted.select("id", "d")), ["id", "d"], "left_semi")
    one = texts.select("id", "d", "text").groupBy("id", "d").agg(F.first("text").alias("text"))
    return one.join(wanted, ["id", "d"])
