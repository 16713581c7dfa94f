"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with smallest period q that is at least max(6, 4 q)
words long. Each text is searched on its own, inside its row's task:

1. Words become numbers by (text, word); prefix doubling ranks all factors of 2, 4, 8 ...
   words and yields the suffix array, to the depth that runs can need.
2. A wavelet tree over the suffix array answers range successor: the next place, after a
   given one, among the suffixes of a range. All queries of a level walk the tree together.
3. Texts are cut into dyadic blocks of L = 2, 4, 8 ... words. A run of period q in [L/2, L)
   holds a whole block with room for q more words before or after it. So the block occurs
   again at distance q in its neighbouring window. Occurrences that close make an arithmetic
   progression; its difference is the candidate period.
4. Neighbouring blocks with one candidate period are joined, and their ends moved word by
   word as long as the period holds. Runs shorter than the limit are dropped; of equal
   stretches the smallest period counts.

Scale: nothing is shuffled. Texts are taken in slices of about SLICE bytes, each text whole.
Ranks are refined only where a factor occurs again, and the tree holds the suffixes whose first
two words do. Memory grows with the words of one slice or of the longest text, by 8 bytes for
each level of blocks and 4 for each level of the tree.

Words of one text are told apart by 64-bit hashes, ranks and places compare numbers.
Defined results: a null or empty text has no words and no run (four nulls); repeated rows get
equal rows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casework.llm.arrays import slices, word_bounds, word_hashes

LEAST, TIMES = 6, 4  # a run has max(LEAST, TIMES * period) words
SLICE = 1_000_000
STRIDE = 32  # words that an end is moved at a time
SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


class WaveletTree:
    """Range successor over an array of distinct numbers below 2**bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.before: list[np.ndarray] = []  # zeros before each place, level by level from the highest bit
        self.zeros: list[int] = []
        level = values.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            zero = (level >> b) & 1 == 0
            count = np.zeros(len(level) + 1, np.int32)
            np.cumsum(zero, out=count[1:])
            self.before.append(count)
            self.zeros.append(int(count[-1]))
            level = np.concatenate((level[zero], level[~zero]))

    def _below(self, depth: int, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, zeros = self.before[depth], self.zeros[depth]
        a, b = count[lo].astype(np.int64), count[hi].astype(np.int64)
        return np.where(bit, zeros + lo - a, a), np.where(bit, zeros + hi - b, b)

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least *least* at places lo to hi (exclusive); -1 where there is none."""
        n = len(least)
        # follow the bits of *least*, and note the last place where the one-branch could be taken instead
        fork = np.full(n, -1)
        fork_lo, fork_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        path_lo, path_hi = lo.astype(np.int64), hi.astype(np.int64)
        too_large = (least >> self.bits) > 0
        path_hi = np.where(too_large, path_lo, path_hi)
        for depth in range(self.bits):
            bit = (least >> (self.bits - 1 - depth)) & 1
            one_lo, one_hi = self._below(depth, path_lo, path_hi, np.ones(n, bool))
            aside = (bit == 0) & (one_hi > one_lo)
            fork[aside], fork_lo[aside], fork_hi[aside] = depth, one_lo[aside], one_hi[aside]
            path_lo, path_hi = self._below(depth, path_lo, path_hi, bit == 1)
        exact = path_hi > path_lo
        out = np.where(exact, least, -1)
        go = np.flatnonzero(~exact & (fork >= 0))
        if len(go):
            depth_of, at_lo, at_hi = fork[go], fork_lo[go], fork_hi[go]
            shift = self.bits - 1 - depth_of
            value = (least[go] >> shift | 1) << shift
            for depth in range(self.bits):
                under = np.flatnonzero(depth_of < depth)
                if not len(under):
                    continue
                zero_lo, zero_hi = self._below(depth, at_lo[under], at_hi[under], np.zeros(len(under), bool))
                one_lo, one_hi = self._below(depth, at_lo[under], at_hi[under], np.ones(len(under), bool))
                one = zero_hi == zero_lo
                at_lo[under], at_hi[under] = np.where(one, one_lo, zero_lo), np.where(one, one_hi, zero_hi)
                value[under] |= one.astype(np.int64) << (self.bits - 1 - depth)
            out[go] = value
        return out


def ranked(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Number of smaller keys, the same for equal keys."""
    order = np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    new = np.ones(len(first), bool)
    ordered = first[order]
    new[1:] = ordered[1:] != ordered[:-1]
    if second is not None:
        ordered = second[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    out = np.empty(len(first), np.int64)
    out[order] = starts[np.cumsum(new) - 1]
    return out


def factor_ranks(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(L, rank of the factor of L words at each place) for L = 2, 4, 8 ..., and the suffix array.

    A rank is the place in the suffix array where the suffixes that begin with the factor start.
    Suffixes are ordered by text, then word by word to twice the greatest L; a text's end comes first.
    """
    n = len(words)
    by_word = ranked(words)
    rank = ranked(text, by_word)
    longest = int((ends - np.arange(n)).max(initial=0))
    levels, size = [], 1
    while True:
        # only places whose factor occurs again are told apart further
        members = np.bincount(rank, minlength=n)
        open_places = np.flatnonzero(members[rank] > 1)
        if size > 1:
            levels.append((size, rank.copy()))
        # a run of period q in [size, 2 size) has TIMES * size words at least
        if not len(open_places) or (size > 1 and TIMES * size > longest):
            break
        after = open_places + size
        inside = after < ends[open_places]
        follow = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        group = rank[open_places]
        order = np.lexsort((open_places, follow, group))
        g, f = group[order], follow[order]
        new_group = np.ones(len(g), bool)
        new_group[1:] = g[1:] != g[:-1]
        new = new_group.copy()
        new[1:] |= f[1:] != f[:-1]
        place = np.arange(len(g))
        in_group = place - np.maximum.accumulate(np.where(new_group, place, 0))
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank = rank.copy()
        rank[open_places[order]] = g + in_group[head]
        size *= 2
    return levels, np.argsort(rank, kind="stable")


def candidates(levels: list[tuple[int, np.ndarray]], suffixes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, a, b): places a to b (exclusive) whose words occur again one period later, from blocks that occur again nearby."""
    n = len(suffixes)
    places = np.arange(n)
    asked = []  # size, blocks, and the suffixes that begin with each
    again = np.zeros(n + 1, np.int64)
    for size, rank in levels:
        count = np.bincount(rank, minlength=n)
        if size == 2:
            np.cumsum(count[rank[suffixes]] > 1, out=again[1:])
        block = places[((places - begins) % size == 0) & (places + size <= ends)]
        block = block[count[rank[block]] > 1]
        lo = rank[block]
        asked.append((size, block, again[lo], again[lo + count[lo]]))
    if not sum(len(block) for _, block, _, _ in asked):
        return (np.zeros(0, np.int64),) * 3
    held = suffixes[again[1:] > again[:-1]]
    parts = []
    for mirror in (False, True):  # the place before is the place after in the mirrored order
        tree = WaveletTree(n - 1 - held if mirror else held, max(n.bit_length(), 1))
        for size, block, lo, hi in asked:
            found = tree.successor(lo, hi, n - block if mirror else block + 1)
            step = block - (n - 1 - found) if mirror else found - block
            near = (found >= 0) & (2 * step >= size) & (step < size)
            a = (block - step if mirror else block)[near]
            parts.append((step[near], a, a + size))
        del tree
    return tuple(np.concatenate(x) for x in zip(*parts))


def joined(text: np.ndarray, period: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one text and period that touch or overlap as one."""
    order = np.lexsort((a, period, text))
    text, period, a, b = text[order], period[order], a[order], b[order]
    if not len(a):
        return period, a, b
    key = np.ones(len(a), bool)
    key[1:] = (text[1:] != text[:-1]) | (period[1:] != period[:-1])
    group = np.cumsum(key)
    # the farthest end so far within a group, by offsetting groups
    span = int(b.max()) + 1
    reach = np.maximum.accumulate(b + group * span) - group * span
    new = key.copy()
    new[1:] |= a[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return period[starts], a[starts], np.maximum.reduceat(b, starts)


def extended(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, period: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b moved outwards as far as words one period apart are equal, inside the text."""
    a, b = a.copy(), b.copy()
    low, high = begins[a], ends[a] - period
    strides = np.arange(STRIDE)
    for edge, way in ((b, 1), (a, -1)):
        go = np.arange(len(a))
        while len(go):
            at = edge[go, None] + (strides if way > 0 else -1 - strides)
            inside = at < high[go, None] if way > 0 else at >= low[go, None]
            safe = np.where(inside, at, low[go, None])
            differs = ~inside | (words[safe] != words[safe + period[go, None]])
            moved = np.where(differs.any(axis=1), differs.argmax(axis=1), STRIDE)
            edge[go] += way * moved
            go = go[moved == STRIDE]
    return a, b


def find_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of texts of *counts* words that stand one after the other, by start and period."""
    text = np.repeat(np.arange(len(counts)), counts)
    limits = np.cumsum(counts)
    ends, begins = limits[text], (limits - counts)[text]
    levels, suffixes = factor_ranks(words, text, ends)
    period, a, b = candidates(levels, suffixes, begins, ends)
    period, a, b = joined(text[a], period, a, b)
    a, b = extended(words, begins, ends, period, a, b)
    length = b - a + period
    good = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = a[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repetition that the document's number asks for."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    rest = n - a
    return words[:a] + (cycle * (rest // p + 1))[:rest]


def collapse(texts: list[list[bytes]]) -> list[list]:
    """For each list of words: the columns of SCHEMA after doc_id."""
    counts = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b" ".join(w for t in texts for w in t), np.uint8)
    words = word_hashes(data, *word_bounds(data)) if len(data) else np.zeros(0, np.uint64)
    start, length, period = find_runs(words, counts)
    limits = np.cumsum(counts)
    owner = np.searchsorted(limits, start, side="right")
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    kept = np.cumsum(drop[:-1]) == 0
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        base = int(limits[i] - counts[i])
        s, n, q = (x[edges[i] : edges[i + 1]].tolist() for x in (start - base, length, period))
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q))
        best = min(zip((-y for y in n), s, q), default=None)
        head = [None] * 4 if best is None else [best[1], -best[0], best[2], 1000 * -best[0] // best[2]]
        words_left = text if not s else [text[j] for j in np.flatnonzero(kept[base : base + len(text)])]
        out.append([len(s), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words_left)).hexdigest()])
    return out


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", plant: bool = False) -> DataFrame:
    """One row per document: its number of runs, the longest run, digests of all runs and of the words without their repetitions.

    *plant* first gives every tenth document a repetition that its number determines.
    """
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for begin, end in slices(batch.column(1), SLICE):
                texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).slice(begin, end - begin).to_pylist()]
                if plant:
                    texts = [planted(i, t) for i, t in zip(ids[begin:end], texts)]
                columns = zip(*collapse(texts))
                arrays = [batch.column(0).slice(begin, end - begin), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)
