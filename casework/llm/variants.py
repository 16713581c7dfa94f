"""Spelling variants by permuterm rotations.

Words of the corpus are counted; those that occur often enough are marked with a terminator and
rotated. Two words that differ by one replaced code point have rotations with that code point at
the end, equal before it. A word with one code point more has a rotation that, without its last
code point, is a whole rotation of the shorter word. So all rotations are sorted, a group is a range
with one prefix (a whole rotation, or one that skips its last code point), and its members are
neighbours. Where equal code points stand together, the skipped one is the first of them, so that no
pair is met twice.

Scale: words are counted in each task before they are shuffled, so a frequent word is one row a
task. A group has at most one word for each letter of the alphabet and one shorter word; rotations
are dealt and sorted by prefix, and a task reads them group by group. A row holds the rotation alone,
which is the word. Prefixes of over LONG code points travel as two 64-bit hashes, and their words as a
digest, so that a word of a million letters makes a million small rows; the real words are looked up
for what is found. Forms are followed by pointer doubling: a form is at least twice as frequent as its
word, so the number of rounds is known from the largest count.

Defined results: null and empty texts have no words; a row without an id counts as one with an empty
number; repeated rows count as often as they stand there; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.arrays import LOWER, U, prefix_hash, range_hash, slices
from casework.llm.shared import Tables

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
END = "$"
LONG = 64  # code points of a prefix that travel as they are
HELD = 200_000  # distinct words that a task counts before it hands them on
ROTATIONS = 100_000  # rotations in a batch


def misspelt(prefix: int, word: str) -> str:
    """The run, or for every 97th (by the checksum of row and run) the run without one code point."""
    h = zlib.crc32(word.encode(), prefix)
    if h % 97:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def _counts(docs: DataFrame, least: int) -> DataFrame:
    """(word, n) of every task's part."""

    def batch(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for whole in batches:
            for begin, end in slices(whole.column(1)):
                part = whole.slice(begin, end - begin)
                for i, text in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER)
                    prefix = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                    for word, n in Counter(RUNS.findall(raw.decode("utf-8", "surrogatepass"))).items():
                        if len(word) >= least and len(word := misspelt(prefix, word)) >= least:
                            held[word] += n
                    if len(held) > HELD:
                        yield batch(held)
                        held.clear()
        if held:
            yield batch(held)

    return docs.mapInArrow(run, "word string, n long")


def reference(word: str) -> str | None:
    """What stands for a word in the rows of long prefixes."""
    return "#" + hashlib.md5(word.encode()).hexdigest() if len(word) >= LONG else None


def rotations(word: str) -> Iterator[tuple[bytes, str, bool]]:
    """(prefix, skipped code point or nothing, whether equal ones stand before it) of every rotation."""
    marked = word + END
    m = len(word)
    if m < LONG:
        for i, c in enumerate(word):
            yield (marked[i + 1 :] + word[:i]).encode(), c, not i or word[i - 1] != c
        for i in range(m + 1):
            yield (marked[i:] + word[:i]).encode(), "", True
        return
    # the same prefixes as hashes: all are substrings of the marked word written twice
    twice = np.array([ord(c) for c in marked * 2], np.uint64)
    hashes = [prefix_hash(twice, w) for w in (0, 1)]
    for length, starts in ((m, np.arange(1, m + 1)), (m + 1, np.arange(m + 1))):
        found = [range_hash(h, starts, starts + length, w) for w, h in enumerate(hashes)]
        short = length <= LONG
        keys = np.stack(found, axis=1).astype(">u8").tobytes()
        for k, start in enumerate(starts.tolist()):
            key = (marked * 2)[start : start + length].encode() if short else b"#" + keys[16 * k : 16 * k + 16]
            if length == m:
                yield key, word[k], not k or word[k - 1] != word[k]
            else:
                yield key, "", True


def _rotated(words: DataFrame) -> DataFrame:
    names = ["prefix", "skipped", "first", "n", "ref"]
    kinds = [pa.binary(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ref = reference(word)
                for rotation in rotations(word):
                    rows.append((*rotation, n, ref))
                    if len(rows) == ROTATIONS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return words.select("word", "n").mapInArrow(run, "prefix binary, skipped string, first boolean, n long, ref string")


def neighbours(prefix: bytes, members: list[tuple[str, bool, int, str | None]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words in this group, largest count among them, one with this count) for the members of a range.

    Members are (skipped, first, n, ref); at most one has nothing skipped. Words that are known by reference
    give a row for each near word of the largest count, since the smallest cannot be told here.
    """
    if prefix.startswith(b"#"):
        named = [ref for _, _, _, ref in members]
    else:
        behind, _, before = prefix.decode().partition(END)
        named = [ref or before + skipped + behind for skipped, _, _, ref in members]
    by_count = sorted(range(len(members)), key=lambda k: (-members[k][2], named[k]))
    for k, (skipped, first, _, _) in enumerate(members):
        near = 0
        best: list[int] = []
        for j in by_count:
            other = members[j]
            # two words that skip a code point differ in it; the whole one is near those that skip the first of equal ones
            if j == k or not ((skipped and other[0]) or (first if skipped else other[1])):
                continue
            near += 1
            # references sort before words
            if not best or (members[best[0]][2] == other[2] and named[best[0]].startswith("#")):
                best.append(j)
        for position, j in enumerate(best):
            yield named[k], 0 if position else near, members[j][2], named[j]


def _scanned(rotated: DataFrame) -> DataFrame:
    """The neighbours of every range of sorted rotations."""
    names = ["ref", "near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: bytes | None = None
        group: list[tuple] = []
        for batch in batches:
            rows: list[tuple] = []
            for prefix, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if prefix != last:
                    if len(group) > 1:
                        rows.extend(neighbours(last, group))
                    last, group = prefix, []
                group.append(tuple(member))
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if len(group) > 1:
            rows = list(neighbours(last, group))
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return rotated.mapInArrow(run, "ref string, near long, best_n long, best string")


def _roots(tables: Tables, links: DataFrame, largest: int) -> DataFrame:
    """(word, root) from (word, form): every round follows twice as many forms."""
    chain = math.log2(max(largest / LEAST_COUNT, 1)) / math.log2(TIMES)
    known = tables.keep("roots-0", links.select("word", F.col("form").alias("root")))
    for k in range(math.ceil(math.log2(max(chain, 1)))):
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = known.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        known = tables.keep(f"roots-{k + 1}", longer)
        tables.drop(f"roots-{k}")
    return known


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every frequent word."""
    tables = Tables(docs.sparkSession, "variants")
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
    counted = _counts(texts, LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    named = F.when(F.length("word") >= LONG, F.concat(F.lit("#"), F.md5(F.col("word").cast("binary")))).otherwise(F.col("word"))
    words = tables.keep("words", counted.withColumn("ref", named))
    sorted_rotations = _rotated(words).repartition("prefix").sortWithinPartitions("prefix", "skipped")
    found = tables.keep("found", _scanned(sorted_rotations))
    long = F.col("best").startswith("#")
    real = words.where(F.col("ref").startswith("#")).select(F.col("ref").alias("best"), F.col("word").alias("real"))
    looked_up = found.where(long).join(real, "best").select("ref", "near", "best_n", F.col("real").alias("best"))
    best = found.where(~long).select("ref", "near", "best_n", "best").union(looked_up)
    best = best.groupBy("ref").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("least"))
    frequent = -F.col("least.n") >= TIMES * F.col("n")
    joined = words.join(best, "ref", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("least.best")).alias("form"),
        F.when(frequent, -F.col("least.n")).alias("form_n"),
    )
    formed = tables.keep("formed", joined)
    tables.drop("words", "found")
    largest = formed.agg(F.max("n")).first()[0] or 0
    roots = _roots(tables, formed.where("form IS NOT NULL"), largest)
    out = formed.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
