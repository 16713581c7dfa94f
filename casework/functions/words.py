"""Text work done over Arrow batches, where the built-in expressions look at every character again for each word."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """As ``text.collapse_spaces``, whose class of blanks is that of ``str.split``."""

    @F.arrow_udf("string")
    def collapse(texts: pa.Array) -> pa.Array:
        given = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([None if t is None else " ".join(t.decode(errors="replace").split()) for t in given], pa.string())

    return collapse(text)


def _any_of(words: Sequence[bytes]) -> str:
    return "|".join(re.escape(w.decode()) for w in words)


class _Search:
    """Finds many words in one pass over a text, by an alternation of all of them.

    Matches do not overlap, so a word can hide behind another: inside it, which is known beforehand, or
    starting inside it and ending after it. The texts that hold such a joint are searched word by word.
    """

    def __init__(self, words: Sequence[str]):
        self.words = [w.encode() for w in words]
        longest_first = sorted(set(self.words), key=lambda w: (-len(w), w))
        joints = {
            a + b[-k:] for a in longest_first for b in longest_first if b not in a for k in range(1, len(b)) if a.endswith(b[:-k]) and a != b[:-k]
        }
        self.pattern = f"({_any_of(longest_first)})"
        self.joints = _any_of(sorted(joints)) or "$^."
        self.known = pa.array(longest_first, pa.large_binary())
        self.holds = np.array([[b in a for b in self.words] for a in longest_first], bool)

    def flags(self, texts: pa.Array) -> np.ndarray:
        """(text, word) flags; a null text holds nothing."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        marked = pc.replace_substring_regex(pc.replace_substring(texts, "\1", "\2"), self.pattern, "\1\\1\1")
        pieces = pc.split_pattern(marked, "\1")  # text, match, text, match, ... text
        row = pc.list_parent_indices(pieces).to_numpy()
        place = np.arange(len(row)) - pieces.offsets.to_numpy()[row] + pieces.offsets[0].as_py()
        at = np.flatnonzero(place % 2)
        match = pc.index_in(pieces.flatten().take(pa.array(at)), value_set=self.known).to_numpy()
        pairs = np.unique(row[at] * len(self.known) + match)
        flags = np.zeros((len(texts), len(self.words)), bool)
        np.logical_or.at(flags, pairs // len(self.known), self.holds[pairs % len(self.known)])
        for i in np.flatnonzero(pc.match_substring_regex(texts, self.joints).to_numpy(zero_copy_only=False)):
            text = texts[int(i)].as_py()
            flags[i] = [w in text for w in self.words]
        return flags


def found_words(text: Column, words: Sequence[str]) -> Column:
    """Which of *words* (no control characters in them) occur anywhere in *text*: an array of booleans, null for a null text."""
    search = _Search(words)

    @F.arrow_udf("array<boolean>")
    def found(texts: pa.Array) -> pa.Array:
        starts = np.arange(len(texts) + 1, dtype=np.int32) * len(search.words)
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(search.flags(texts).ravel()), mask=texts.is_null())

    return found(text)
