"""Encoding against the tiktoken library, exact round trips, edge cases."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from casework.llm import bpe, queries
from casework.llm.bpe import LATIN_PATTERN, Codec, decode_ids, encode_texts

PATH, PATTERN = queries.VOCABULARY, public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    own = Codec(PATH, PATTERN, LATIN_PATTERN)
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def random_texts():
    rng = random.Random(1)
    wide = list("ab cé \n\t  1²٣½Ⅷ_'sdtre!.  \x1c\x1d\x85᠎﻿ßİ中文字😀́‍") + ["<|endoftext|>", "'ll", "   "]
    latin = [c for c in wide if max(c) <= "ɏ"] + ["ɏ", "ƻ", "×", "÷", "ª"]
    for alphabet in (wide, latin):
        for _ in range(1500):
            yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
    yield from ["", "a" * 300, "ab" * 400, "abcabd" * 200, " " * 900, "é" * 500, "0" * 257, "word " * 20000, "\x00\x01"]


def test_as_tiktoken(both):
    own, library = both
    texts = list(random_texts())
    got = own.encode(texts)
    assert got.to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert own.decode(got) == [t.encode() for t in texts]


def test_query_and_heap_contract_alike(both):
    own, _ = both
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abcdetion \xc3\xa9") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    assert own.merge_words(words) == [own.merge_long(w) for w in words]


def test_words_are_looked_up_once():
    """A slice asks for each of its words once, however often it stands there, and the recursion moves rows, not lists."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    own = Codec(PATH, PATTERN, LATIN_PATTERN)
    own.known = Counted()
    got = own.encode(["qzxjk vwqpt" * 300, None, "vwqpt" * 2, ""]).to_pylist()
    assert Counted.asked <= len(own.known) == 4
    assert [len(x) > 0 for x in got] == [True, False, True, False]
    assert own.decode(pa.array(got, pa.list_(pa.int32()))) == [b"qzxjk vwqpt" * 300, b"", b"vwqpt" * 2, b""]
    assert not [c for c in own.db.sql(bpe.ENCODE).to_arrow_table().schema.types if pa.types.is_list(c)]


def test_edges_of_the_recursion(both):
    own, _ = both
    words = [b"a", b"\xff", b"the" * 85 + b"s", b"\x00" * 256, b"ab", b"\xc3\xa9" * 128]
    assert own.merge_words(words) == [own.merge_long(w) for w in words]


def test_decoding_in_pieces(both, monkeypatch):
    texts = list(random_texts())[::7]
    ids = both[0].encode(texts)
    monkeypatch.setattr(bpe, "TOKENS", 7)
    assert both[0].decode(ids) == [t.encode() for t in texts]
    assert both[0].decode(ids.slice(5, 9)) == [t.encode() for t in texts[5:14]]


def test_encoded_and_decoded_at_once(spark):
    df = spark.createDataFrame([(1, "é twice"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.back) for r in encode_texts(df, PATH, PATTERN, bytes_column="back").collect()}
    assert got == {1: "é twice".encode(), 2: b"", 3: b""}
    with pytest.raises(ValueError):
        encode_texts(df, PATH, PATTERN, bytes_column="text")


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "twice twice", 3), (4, "long " * 30000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("n_tokens", F.lit("clash"))
    out = decode_ids(encode_texts(df, PATH, PATTERN), PATH, PATTERN)
    assert out.columns == [*df.columns, "token_ids", "decoded"]
    got = out.collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t, _ in rows)
    assert encode_texts(df.limit(0), PATH, PATTERN).collect() == []
    with pytest.raises(ValueError):
        encode_texts(out, PATH, PATTERN)
    nulls = spark.createDataFrame([([None, 5],), (None,), ([],)], "token_ids array<int>")
    assert sorted(len(r.decoded) for r in decode_ids(nulls.where("token_ids IS NULL OR size(token_ids) = 0"), PATH, PATTERN).collect()) == [0, 0]


def test_unknown_ids_raise(both):
    with pytest.raises(ValueError):
        both[0].decode(pa.array([[5, 60000]], pa.list_(pa.int32())))
    assert both[0].decode(pa.array([[5, None]], pa.list_(pa.int32()))) == both[0].decode(pa.array([[5]], pa.list_(pa.int32())))


def test_query(spark, sf, both):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = both[1].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
