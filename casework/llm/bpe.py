"""Byte-level BPE by recursive queries in each partition.

Texts are split by the tokenizer's pattern. The words that a task has not met yet
become rows of neighbouring tokens in an embedded DuckDB, one row for each place in a
word; a recursive query joins them with the merge table and contracts, in every word,
the leftmost pair of least rank, until no word changes. Decoding joins token positions
with the vocabulary and puts the bytes together in the order of the positions.

Scale: every row is encoded in its own task, and decoded there too if asked; nothing is
shuffled. Only distinct words go through the recursion, in parts whose rounds hold at most
STEPS tokens, and a task keeps at most CACHE words. Decoding takes TOKENS tokens at a time,
however long a text is. So the database needs no disk and may use none. The query does one
contraction a round, so its cost grows with the square of a word's length; words over LONG
bytes take the same steps in a heap.

Defined results: a null text counts as empty and has no tokens; an id that the
vocabulary does not have raises; null ids decode to nothing; repeated rows get
repeated results; an empty table gives an empty one; other columns pass through.
The vocabulary file is a parameter and must be readable where the tasks run.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count, islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from casework.llm.arrays import slices

KEPT = 50_000  # words that a worker remembers between tasks, those it met first
STEPS = 1_000_000  # sum of the squares of the word lengths in one recursion
CACHE = 400_000
LONG = 256
SLICE = 1_500_000  # bytes of text that are encoded at a time
TOKENS = 250_000  # token rows that one decoding query takes

# a row is two neighbouring tokens, left << 32 | right; EDGE stands before the first and after the last token of a word;
# its place is position of the left token << 16 | position of the right one
EDGE = 2**31 - 1
ENCODE = """
WITH RECURSIVE step(word, place, pair, done) AS (
    SELECT word, place, pair, false FROM start
    UNION ALL
    (WITH best AS (
        SELECT word, min(id << 32 | place) AS least FROM step JOIN merges USING (pair) WHERE NOT done GROUP BY word),
     chosen AS (
        SELECT word, least >> 32 AS id, least & 4294967295 AS gone, least >> 16 & 65535 AS l, least & 65535 AS r FROM best)
     SELECT word, (CASE WHEN place >> 16 = r THEN l << 16 | (place & 65535) ELSE place END)::INT,
        CASE WHEN place >> 16 = r THEN id << 32 | (pair & 4294967295)
             WHEN place & 65535 = l THEN (pair & -4294967296) | id ELSE pair END,
        id IS NULL
     FROM step LEFT JOIN chosen USING (word) WHERE NOT done AND place IS DISTINCT FROM gone))
SELECT word, place, pair FROM step WHERE done
"""
DECODE = "SELECT t.pos, v.bytes FROM given t JOIN vocabulary v ON v.id = t.id ORDER BY t.pos"

#: For texts without a character beyond U+024F: classes of that range written out for the faster engine.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r" \t\n\v\f\r\x85\xa0"
LATIN_PATTERN = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
BEYOND_LATIN = re.compile("[^\x00-\u024f]")


class Codec:
    """The merge table and vocabulary of one rank file in an embedded database of this process."""

    def __init__(self, path: str, pattern: str, latin_pattern: str | None = None):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.latin = re.compile(latin_pattern) if latin_pattern else None
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers

    @cached_property
    def db(self) -> duckdb.DuckDBPyConnection:
        """The database with the merge table and the vocabulary, from the first use to the end of the task."""
        db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        tokens = pa.array(list(self.ranks), pa.binary())
        vocabulary = pa.table({"id": np.array(list(self.ranks.values()), np.int32), "bytes": tokens})
        rows = np.array([(*pair, rank) for pair, rank in self.merges.items()], np.int64).reshape(-1, 3)
        merges = pa.table({"pair": rows[:, 0] << 32 | rows[:, 1], "id": rows[:, 2]})
        for name, arriving in (("vocabulary", vocabulary), ("merges", merges)):
            db.register("arriving", arriving)
            db.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
            db.unregister("arriving")
        return db

    def rest(self) -> None:
        """Gives memory back at the end of a task; the worker process may do other work next."""
        if "db" in self.__dict__:
            self.__dict__.pop("db").close()
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))

    def load(self, name: str, rows: pa.Table) -> None:
        self.db.register("arriving", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM arriving")
        self.db.unregister("arriving")

    @cached_property
    def merges(self) -> dict[tuple[int, int], int]:
        """Id of every pair of tokens that make a token."""
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                pair = (self.ranks.get(token[:cut]), self.ranks.get(token[cut:]))
                if None not in pair:
                    found[pair] = rank
        return found

    def split(self, text: str) -> list[str]:
        if self.latin and not BEYOND_LATIN.search(text):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word by the recursive query."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes + 1)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
        left, right = np.full((2, len(word)), EDGE, np.int64)
        left[pos > 0] = right[pos < sizes[word]] = self.single[data]
        pair = left << 32 | right & 0xFFFFFFFF
        self.load("start", pa.table({"word": word.astype(np.int32), "place": (pos << 16 | pos + 1).astype(np.int32), "pair": pair}))
        found = self.db.sql(ENCODE).to_arrow_table()
        word, place, pair = (found[name].to_numpy() for name in ("word", "place", "pair"))
        token = pair & 0xFFFFFFFF
        word, place, token = (x[token != EDGE] for x in (word, place, token))
        flat = token[np.lexsort((place, word))].astype(np.int32).tobytes()
        at = [0, *(4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()]
        return [flat[a:b] for a, b in zip(at, at[1:])]

    def merge_long(self, word: bytes) -> bytes:
        """The same contractions for one long word, with a heap of (rank, place)."""
        merges = self.merges
        tok: list[int | None] = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        after, before = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))

        def rank(i: int) -> int | None:
            j = after[i]
            return merges.get((tok[i], tok[j])) if j < len(tok) else None

        heap = [(r, i) for i in range(len(tok)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if tok[i] is None or rank(i) != r:
                continue
            j = after[i]
            tok[i], tok[j], after[i] = r, None, after[j]
            if after[j] < len(tok):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (new := rank(k)) is not None:
                    heapq.heappush(heap, (new, k))
        return np.array([t for t in tok if t is not None], np.int32).tobytes()

    def learn(self, words: list[str]) -> None:
        """Adds the ids of words that are not known yet."""
        todo: list[tuple[str, bytes]] = []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self.known[word] = whole.to_bytes(4, sys.byteorder)
            elif len(data) > LONG:
                self.known[word] = self.merge_long(data)
            else:
                todo.append((word, data))
        weight = np.cumsum([len(d) ** 2 for _, d in todo])
        edges = [0, *(np.flatnonzero(np.diff(weight // STEPS)) + 1).tolist(), len(todo)]
        for at, end in zip(edges, edges[1:]):
            part = todo[at:end]
            if part:
                self.known.update(zip([w for w, _ in part], self.merge_words([d for _, d in part])))

    def encode(self, texts: list[str | None]) -> pa.Array:
        """The ids of each whole text, as lists."""
        split = [self.split(t or "") for t in texts]
        bounds = np.cumsum([0, *map(len, split)])
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        place = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int32, bounds[-1])
        words = list(numbers)
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = words
        self.learn(fresh)
        parts = [self.known[w] for w in words]
        flat = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.array([len(p) // 4 for p in parts], np.int32)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        ids = [np.zeros(0, np.int32)]
        for start in range(0, len(place), TOKENS):
            part = place[start : start + TOKENS]
            size = sizes[part]
            ends = np.cumsum(size, dtype=np.int64)
            ids.append(flat[np.repeat(starts[part] - ends + size, size) + np.arange(ends[-1])])
        offsets = np.concatenate(([0], np.cumsum(sizes[place], dtype=np.int64)))[bounds].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))

    def decode(self, rows: pa.Array) -> list[bytes]:
        """Bytes of each list of ids."""
        row, ids = pc.list_parent_indices(rows), rows.flatten()
        if ids.null_count:
            row, ids = row.filter(ids.is_valid()), ids.drop_null()
        row = row.to_numpy(zero_copy_only=False)
        out = [b""] * len(rows)
        for start in range(0, len(ids), TOKENS):
            part, own = ids.slice(start, TOKENS), row[start : start + TOKENS]
            self.db.register("given", pa.table({"pos": np.arange(len(part), dtype=np.int32), "id": part}))
            found = self.db.sql(DECODE).to_arrow_table()["bytes"].cast(pa.binary()).combine_chunks()
            self.db.unregister("given")
            if len(found) != len(part):
                raise ValueError("an id is not in the vocabulary")
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(found).to_numpy())))[edges].tolist()
            _, offsets, data = found.buffers()
            data = memoryview(data or b"")[np.frombuffer(offsets, np.int32)[found.offset] :]
            for r, a, b in zip(own[edges[:-1]].tolist(), ends, ends[1:]):
                out[r] += data[a:b]
        return out


_codecs: dict[tuple[str, str, str | None], Codec] = {}


def codec(path: str, pattern: str, latin_pattern: str | None = None) -> Codec:
    """One codec for each rank file and worker process."""
    key = (path, pattern, latin_pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def resting(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from batches
    finally:
        own.rest()


def _added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"column {name} is there already; choose another name")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_texts(
    df: DataFrame,
    path: str,
    pattern: str,
    text_column: str = "text",
    ids_column: str = "token_ids",
    latin_pattern: str | None = None,
    bytes_column: str | None = None,
) -> DataFrame:
    """The rows of *df* with the token ids of the whole text, and in *bytes_column*, if given, what they decode to.

    *latin_pattern*, if given, must split texts up to U+024F as *pattern* does.
    """
    place = df.columns.index(text_column)
    schema = _added(df, ids_column, T.ArrayType(T.IntegerType()))
    if bytes_column:
        if bytes_column in schema.names:
            raise ValueError(f"column {bytes_column} is there already; choose another name")
        schema = T.StructType([*schema.fields, T.StructField(bytes_column, T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, latin_pattern)
        yield from resting(own, each(own, batches))

    def each(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for start, end in slices(texts, SLICE):
                ids = own.encode(texts.slice(start, end - start).to_pylist())
                columns = [c.slice(start, end - start) for c in batch.columns]
                added = [ids, pa.array(own.decode(ids), pa.binary())] if bytes_column else [ids]
                yield pa.RecordBatch.from_arrays([*columns, *added], names=names)

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, pattern: str, ids_column: str = "token_ids", bytes_column: str = "decoded") -> DataFrame:
    """The rows of *df* with the bytes that the ids stand for."""
    place = df.columns.index(ids_column)
    names = [*df.columns, bytes_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        yield from resting(own, each(own, batches))

    def each(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array(own.decode(batch.column(place)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    return df.mapInArrow(run, _added(df, bytes_column, T.BinaryType()))
