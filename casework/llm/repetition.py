"""Quality rules from repetition coverage.

Each text is measured inside its own row: rolling hashes of several n-gram
lengths mark the words that stand in an n-gram (or a line) seen before in the
same text, and the characters of the marked words are compared with those of
all words. Nothing is shuffled and no text is cut; memory is one text's arrays.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows get equal rows; an empty table gives an empty one; other columns
of the input are not read. Very long texts are measured whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casework.llm.arrays import covered, window_hashes, word_bounds, word_hashes

#: N-gram length -> largest share (per cent) of word characters inside repeated n-grams.
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Largest share (per cent) of word characters inside repeated lines.
LINE_LIMIT = 20
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")
GRAMS = tuple(f"dup_chars_{n}" for n in NGRAM_LIMITS)
SCHEMA = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS + GRAMS)}, base_failed boolean, kept boolean"


def repeated_places(keys: np.ndarray) -> np.ndarray:
    """Places whose key occurs twice or more."""
    ordered = np.sort(keys)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.flatnonzero(np.isin(keys, again)) if len(again) else np.zeros(0, np.int64)


def later_places(keys: np.ndarray) -> np.ndarray:
    """Places whose key occurs before."""
    places = repeated_places(keys)
    if not len(places):
        return places
    again = np.ones(len(places), bool)
    again[np.unique(keys[places], return_index=True)[1]] = False
    return places[again]


def in_lines(raw: bytes, starts: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of lines with a word that equal an earlier one; which words stand in them."""
    lines = raw.split(b"\n")
    none = np.zeros(len(starts), bool)
    if len(set(lines)) == len(lines):
        return 0, none
    seen: set[bytes] = set()
    repeated = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        repeated[i] = line in seen
        seen.add(line)
    edges = np.cumsum([len(line) + 1 for line in lines])
    line_of = np.searchsorted(edges, starts, side="right")
    with_word = np.zeros(len(lines), bool)
    with_word[line_of] = True
    return int((repeated & with_word).sum()), repeated[line_of]


def measure(text: str | None) -> list:
    """The counts in the order of SCHEMA, without the id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    n = len(starts)
    # code points before each byte: continuation bytes do not count
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    words = word_hashes(data, starts, ends) if n else np.zeros(0, np.uint64)
    total = int(chars.sum())
    places = repeated_places(window_hashes(words, 3))
    repeat_words = int(covered(places, 3, n).sum()) if len(places) else 0
    dup_lines, inside = in_lines(raw, starts)
    line_chars = int(chars[inside].sum())
    grams, more = [], len(places) > 0
    for size in NGRAM_LIMITS:
        # a repeated n-gram holds repeated shorter ones: without those there is none
        again = later_places(window_hashes(words, size)) if more else places[:0]
        more = len(again) > 0
        grams.append(int(chars[covered(again, size, n)].sum()) if more else 0)
    base_failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    kept = (
        not base_failed
        and 100 * line_chars <= LINE_LIMIT * total
        and all(100 * g <= limit * total for g, limit in zip(grams, NGRAM_LIMITS.values()))
    )
    return [n, total, int(SYMBOLS[data].sum()), dup_lines, repeat_words, line_chars, *grams, base_failed, kept]


def repetition_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the counts, the base rule and the verdict of the coverage limits."""
    names = ["doc_id", *COUNTS, *GRAMS, "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * (1 + len(COUNTS) + len(GRAMS)) + [pa.bool_()] * 2
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)
