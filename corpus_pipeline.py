"""From raw documents to token ids: quality, near duplicates, secrets, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept; its result is written as Parquet and read again. All stages but the last return
the columns of documents. Nulls, empty texts, repeated rows and empty tables are
defined by the operators: documents that the classifier rejects go; of each group of
near copies the document with the smallest id stays; secrets are replaced in place;
the mixture reads a document as often as its source's budget says; every row that is
left is encoded whole, and decoded again to prove it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm.bpe import LATIN_PATTERN, encode_texts
from casework.llm.jaccard import drop_similar
from casework.llm.mixture import mix_sources, take_mixture
from casework.llm.quality import fit_quality, keep_good
from casework.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, VOCABULARY, mix_path
from casework.llm.secrets import redact_secrets
from casework.session import cut_lineage

#: The mixture hands out as many tokens as there are.
BUDGET_PERCENT = 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit_quality(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(
        docs, mix_path(), MIX_WEIGHTS, BUDGET_PERCENT, MIX_EPOCHS, MIX_SEED, copies_column="_copies"
    )
    return take_mixture(docs, mixed, "_copies")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids, their number and the digest of the decoded bytes."""
    kept = docs.select("doc_id", "lang", "source", "text")
    encoded = encode_texts(
        kept, VOCABULARY, public_tokenizers.PATTERN, latin_pattern=LATIN_PATTERN, bytes_column="decoded"
    )
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "token_ids",
    )


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("secret scan", secrets),
    ("source mixture", mixture),
    ("byte-level tokens", tokens),
]

#: SQL cannot train the classifier; tests/llm/test_pipeline.py holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
