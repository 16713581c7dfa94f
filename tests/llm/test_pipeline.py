"""The pipeline against a plain version, stage by stage."""

import collections
import hashlib

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from casework.llm import queries
from casework.llm.bpe import Codec
from casework.llm.quality import THRESHOLD, fit_quality
from casework.llm.secrets import find_secrets, redact
from tests.llm.test_jaccard import brute


def plain(spark, sf):
    """{(doc_id, digest of the text): copies} that the last stage must encode."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) >= THRESHOLD]
    kept = {c for _, n, c in brute([(r.doc_id, r.text) for r in rows]) if n}
    rows = [r for r in rows if r.doc_id in kept or not (r.text or "").split()]
    rows = [(r.doc_id, redact(r.text, find_secrets(r.text)), r.lang, r.source) for r in rows]
    con = duckdb.connect()
    columns = list(zip(*rows))
    con.register("kept", pa.table(dict(zip(("doc_id", "text", "lang", "source"), map(list, columns)))))
    sql = f"WITH {queries.mixture_sql('kept', corpus_pipeline.BUDGET_PERCENT)} SELECT doc_id, copies FROM mixed"
    copies = dict(con.execute(sql).fetchall())
    return {(i, text): copies[i] for i, text, _, _ in rows if copies[i]}


def test_whole_run(spark, sf):
    expected = plain(spark, sf)
    got = corpus_pipeline.run(spark, sf).collect()
    own = Codec(queries.VOCABULARY, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    text_of = {i: t or "" for i, t in expected}
    assert collections.Counter(r.doc_id for r in got) == {i: n for (i, _), n in expected.items()}
    for r in got:
        assert list(r.token_ids) == library.encode_ordinary(text_of[r.doc_id])
        assert r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(text_of[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf, name, stage):
    rows = [
        (1, "fine words of a text that is long enough to keep here", "en", "src1", 5),
        (1, "fine words of a text that is long enough to keep here", "en", "src1", 5),
        (None, None, None, None, None),
        (2, "", "en", "src2", 0),
        (3, "word " * 30000, None, "other", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, sf)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns
    assert out.count() <= 4 * len(rows)
    assert stage(spark, docs.limit(0), sf).collect() == []
