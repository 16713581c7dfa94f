"""TF-IDF and the other numeric features.

Terms, runs of neighbouring words, are counted where the words of a row are read. Neither the words of a
document nor the rare terms cross the network as text: sums over hashes of terms come first and tell which terms can
be among the most frequent, and only those are summed by their text. The vocabulary, whose
size the spec bounds, is broadcast, and each row looks its own terms up in it: no join
and no regrouping, so that rows keep their place whether their ids are unique or not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casework.functions.numbers import round_even
from casework.functions.text import strip_accents
from casework.session import compute_once, cut_lineage, kept_for_now, small_batches

WORDS_AND_APOSTROPHES = r"[\p{L}\p{N}_']+"
WORDS_OF_TWO = r"[\p{L}\p{N}_]{2,}"
ENGLISH = "english"
SLICE = 1000  # rows whose words are numbered together
WORDS_AT_ONCE = 150_000  # words whose runs are held together, in whole rows
ROW_BITS = 12  # of a hash, given up for the number of the row
PIECES = 256  # ranges of the hashes, each summed by itself
SUMS_AT_ONCE = 1_000_000  # sums that a task holds before it sends them
LAST = np.uint64(2**20 - 1)  # the bits by which most hashes are told from the wanted ones
# No match of these has a blank, so that a term has one way only to be a run of words.
BLANKLESS = (WORDS_AND_APOSTROPHES, WORDS_OF_TWO)


@dataclass(frozen=True)
class TfidfSpec:
    """min_df and max_df are counts when whole numbers of type int, shares when floats.

    stop_words: the words, or ENGLISH for Spark's own list.
    """

    ngrams: tuple[int, int] = (1, 2)
    max_features: int = 50_000
    min_df: int | float = 2
    max_df: int | float = 1.0
    sublinear: bool = True
    stop_words: tuple[str, ...] | str = ()
    token_pattern: str = WORDS_AND_APOSTROPHES


# The configurations in use.
PRESETS = {
    "classifier": TfidfSpec(),
    "encoder": TfidfSpec(token_pattern=WORDS_OF_TWO),
    "outcome": TfidfSpec((1, 3), 8_000, 1, sublinear=False, stop_words=ENGLISH, token_pattern=WORDS_OF_TWO),
    "outcome_text": TfidfSpec((1, 3), 10_000, 3, 0.9, sublinear=False, stop_words=ENGLISH, token_pattern=WORDS_OF_TWO),
    "case_type": TfidfSpec((1, 2), 30_000, 1, 0.95, stop_words=ENGLISH, token_pattern=WORDS_OF_TWO),
    "hierarchy": TfidfSpec((1, 2), 10_000, 2, token_pattern=WORDS_OF_TWO),
    "hierarchy_later": TfidfSpec((1, 2), 15_000, 2, 0.95, stop_words=ENGLISH, token_pattern=WORDS_OF_TWO),
    "sub_type": TfidfSpec((1, 2), 20_000),
    "sub_type_flat": TfidfSpec((1, 2), 20_000, 2, sublinear=False, token_pattern=WORDS_OF_TWO),
}


def tokens(text: Column, spec: TfidfSpec) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    plain = F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(strip_accents(lower))
    found = F.regexp_extract_all(plain, F.lit(spec.token_pattern), F.lit(0))
    if not spec.stop_words:
        return found
    words = spec.stop_words
    if isinstance(words, str):
        words = StopWordsRemover.loadDefaultStopWords(words)
    return F.filter(found, lambda t: ~t.isin(*words))


def _numbered(row: np.ndarray, words: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number) of each run of low..high neighbouring words of a row, and the runs in order, joined by a blank."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    single = coded.dictionary.take(order)
    rank = np.empty(len(single), np.int64)
    rank[order.to_numpy()] = np.arange(len(single))
    code = rank[coded.indices.to_numpy()]
    base = len(single) + 1
    starts = [np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :]) for n in range(1, high + 1)]
    rows = np.concatenate([row[s] for s in starts[low - 1 :]])
    if base**high < 2**62 and not pc.any(pc.match_substring_regex(single, "[\\x00-\\x20]")).as_py():
        # a run as a number whose digits are its words, none being 0: the order of the numbers is that of the joined runs
        keys = [
            sum((code[s + j] + 1) * base ** (high - 1 - j) for j in range(n)) for n, s in enumerate(starts, 1) if n >= low
        ]
        runs, number = np.unique(np.concatenate(keys), return_inverse=True)
        digits = [runs // base ** (high - 1 - j) % base - 1 for j in range(high)]
        parts = [single.take(pa.array(d, mask=d < 0)) for d in digits]
        return rows, number, pc.binary_join_element_wise(*parts, " ", null_handling="skip")
    joined = [
        pc.binary_join_element_wise(*[single.take(pa.array(code[s + j])) for j in range(n)], " ")
        for n, s in enumerate(starts, 1)
        if n >= low
    ]
    coded = pa.concat_arrays(joined).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rows, rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _row_terms(words: pa.Array, low: int, high: int) -> pa.Array:
    """(term, tf) of each list of words, in term order; terms are runs of low..high words joined by a blank."""
    rows, number, names = _numbered(pc.list_parent_indices(words).to_numpy(), words.flatten(), low, high)
    terms, tf = np.unique(rows * max(1, len(names)) + number, return_counts=True)
    row, term = np.divmod(terms, max(1, len(names)))
    entries = [names.take(pa.array(term)), pa.array(tf, pa.int32())]
    return pa.ListArray.from_arrays(_offsets(row, len(words)), pa.StructArray.from_arrays(entries, names=["term", "tf"]))


def with_terms(df: DataFrame, text: str, spec: TfidfSpec, out: str = "terms") -> DataFrame:
    """*df* with ``terms``: array of (term, tf) in term order, counted inside the row."""
    low, high = spec.ngrams

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def counted(words: pa.Array) -> pa.Array:
        slices = [_row_terms(words.slice(i, SLICE), low, high) for i in range(0, max(1, len(words)), SLICE)]
        return slices[0] if len(slices) == 1 else pa.concat_arrays(slices)

    df = compute_once(df, {"_words": tokens(F.col(text), spec)})
    return compute_once(df.withColumn(out, counted("_words")).drop("_words"), {out: F.col(out)})


def with_row_terms(df: DataFrame, text: str, spec: TfidfSpec, out: str = "terms") -> DataFrame:
    """*df* with what the functions below read terms from: the words in order, or ``with_terms`` where words may hold blanks.

    Words are about as long as the text; their runs, counted, are many times that.
    """
    if spec.token_pattern in BLANKLESS:
        return compute_once(df, {out: tokens(F.col(text), spec)})
    return with_terms(df, text, spec, out)


def term_counts(df: DataFrame, row_id: str, text: str, spec: TfidfSpec, *carry: str) -> DataFrame:
    """One row per document with ``terms``, see ``with_row_terms``."""
    return with_row_terms(df.select(row_id, *carry, text), text, spec).select(row_id, *carry, "terms")


def _are_words(counted: DataFrame) -> bool:
    return not isinstance(counted.schema["terms"].dataType.elementType, StructType)


def term_stats(counted: DataFrame, *by: str, spec: TfidfSpec | None = None) -> DataFrame:
    """(by, term, total, df): how often a term occurs and in how many rows. A batch sends one row for each term.

    *spec* tells the runs to count where ``terms`` are words.
    """
    source = counted.select(*by, "terms")
    schema = StructType([*source.schema.fields[:-1], *StructType.fromDDL("term string, total long, df long").fields])
    runs = (spec or TfidfSpec()).ngrams if _are_words(counted) else None

    def partial(batches):
        for batch in batches:
            for at, some in _slices(batch.column(len(by))):
                lists = _row_terms(some, *runs) if runs else some
                term, tf = lists.flatten().flatten()
                row = pc.list_parent_indices(lists)
                table = pa.table([*(batch.column(i).slice(at).take(row) for i in range(len(by))), term, tf], [*by, "term", "tf"])
                sums = table.group_by([*by, "term"]).aggregate([("tf", "sum"), ("tf", "count")])
                sums = sums.select([*by, "term", "tf_sum", "tf_count"]).rename_columns([*by, "term", "total", "df"])
                yield from sums.combine_chunks().to_batches()

    sums = source.mapInArrow(partial, schema)
    return sums.groupBy(*by, "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _slices(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in order, few enough to hold the runs of their words."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS_AT_ONCE, "right"))
        stop = min(max(fit, at + 1), at + 2**ROW_BITS, len(lists))
        yield at, lists.slice(at, stop - at)
        at = stop


def _in_slices(make: Callable[[pa.Array], pa.Array], rows: pa.Array, lists: pa.Array) -> pa.Array:
    """*make* of *rows* whose *lists* are beside them, a slice at a time."""
    return pa.concat_arrays([make(rows.slice(at, len(some))) for at, some in _slices(lists)] or [make(rows)])


def _run_starts(row: np.ndarray, n: int) -> np.ndarray:
    """Where *n* neighbouring words of a row begin."""
    return np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where equal values begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _run_hashes(words: pa.Array, low: int, high: int) -> tuple[np.ndarray, pa.DictionaryArray, list[np.ndarray], list[np.ndarray]]:
    """The row of each word, the words numbered, and for each length of run where runs begin and their hashes."""
    row = pc.list_parent_indices(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    hashes = hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)
    word = hashes[coded.indices.to_numpy()]
    starts = [_run_starts(row, n) for n in range(low, high + 1)]
    keys = []
    for n, s in enumerate(starts, low):
        key = word[s]
        for j in range(1, n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + word[s + j]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        keys.append(key >> np.uint64(ROW_BITS))
    return row, coded, starts, keys


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]  # key, total, df in the order of keys


def _sums(row: np.ndarray, key: np.ndarray) -> Sums:
    """Occurrences of each key and the rows that have it."""
    both = (key << np.uint64(ROW_BITS)) | row.astype(np.uint64)
    both.sort()
    first = _heads(both)
    pair = both[first] >> np.uint64(ROW_BITS)
    head = _heads(pair)
    return pair[head], np.diff(np.append(first[head], len(both))), np.diff(np.append(head, len(pair)))


def _merged(parts: Sequence[Sums]) -> Sums:
    if len(parts) == 1:
        return parts[0]
    key, total, df = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    key = key[order]
    head = _heads(key)
    return (key[head], *(np.add.reduceat(x[order], head) if len(head) else x for x in (total, df)))


PIECE = "piece int, once binary, keys binary, totals binary, dfs binary"


def _sent(sums: Sums) -> pa.RecordBatch:
    """A row for each range of keys; keys that occur once, nearly all of them, travel without their counts."""
    key, total, df = sums
    cuts = np.searchsorted(key >> np.uint64(64 - ROW_BITS - 8), np.arange(PIECES + 1, dtype=np.uint64))
    rows = []
    for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        once = total[a:b] == 1
        many = ~once
        rows.append((piece, key[a:b][once].tobytes(), *(x[a:b][many].astype(kind).tobytes() for x, kind in ((key, np.uint64), (total, np.int64), (df, np.int64)))))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECE.split(", ")])


def _received(table: pa.Table) -> Sums:
    parts = []
    _, *columns = (c.to_pylist() for c in table.columns)
    for once, keys, totals, dfs in zip(*columns):
        single = np.frombuffer(once, np.uint64)
        parts.append((single, np.ones(len(single), np.int64), np.ones(len(single), np.int64)))
        parts.append((np.frombuffer(keys, np.uint64), np.frombuffer(totals, np.int64), np.frombuffer(dfs, np.int64)))
    return _merged(parts)


def _bounds(spec: TfidfSpec, n: int) -> tuple[float, float]:
    return tuple(v if isinstance(v, int) else v * n for v in (spec.min_df, spec.max_df))


def _hash_sums(counted: DataFrame, spec: TfidfSpec, n: int) -> DataFrame:
    """(piece, sums): occurrences and rows of the hashes of terms, but not of those that stay below ``max_features`` others."""
    low, high = spec.ngrams
    (least, most), size = _bounds(spec, n), spec.max_features

    def partial(batches):
        held, held_size = [], 0
        for batch in batches:
            for _, lists in _slices(batch.column(0)):
                row, _, starts, keys = _run_hashes(lists, low, high)
                held.append(_sums(np.concatenate([row[s] for s in starts]), np.concatenate(keys)))
                held_size += len(held[-1][0])
                if held_size > SUMS_AT_ONCE:
                    held = [_merged(held)]
                    held_size = len(held[0][0])
                    if held_size > SUMS_AT_ONCE // 2:
                        yield _sent(held.pop())
                        held_size = 0
        if held:
            yield _sent(_merged(held))

    def whole(table: pa.Table) -> pa.Table:
        key, total, df = _received(table)
        can = df >= least
        key, total, df = key[can], total[can], df[can]
        counts = total[df <= most]
        if len(counts) > size:
            can = total >= np.partition(counts, -size)[-size]
            key, total, df = key[can], total[can], df[can]
        return pa.table({"key": pa.array(key.astype(np.int64)), "total": pa.array(total, pa.int64()), "df": pa.array(df, pa.int64())})

    return counted.select("terms").mapInArrow(partial, PIECE).groupBy("piece").applyInArrow(whole, "key long, total long, df long")


def _named_stats(counted: DataFrame, spec: TfidfSpec, keys: np.ndarray) -> DataFrame:
    """(term, total, df) of the terms whose hashes are among the sorted *keys*."""
    low, high = spec.ngrams
    small = np.zeros(int(LAST) + 1, bool)  # most other hashes are told by their last bits
    small[keys & LAST] = True
    sent = counted.sparkSession.sparkContext.broadcast((keys, small))

    def partial(batches):
        keys, small = sent.value
        held, held_rows = [], 0
        for batch in batches:
            for _, lists in _slices(batch.column(0)):
                row, coded, starts, hashes = _run_hashes(lists, low, high)
                code, base = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary) + 1
                rows, places, runs = [], [], []
                for n, (s, key) in enumerate(zip(starts, hashes), low):
                    at = np.flatnonzero(small[key & LAST])
                    key, at = key[at], s[at]
                    place = np.searchsorted(keys, key)
                    hit = place < len(keys)
                    hit[hit] = keys[place[hit]] == key[hit]
                    at = at[hit]
                    rows.append(row[at])
                    places.append(place[hit])
                    # a run as a number whose digits are its words, none being 0
                    runs.append(sum((code[at + j] + 1) * base ** (high - 1 - j) for j in range(n)))
                number, runs = np.concatenate(places), np.concatenate(runs)
                own = np.zeros(len(keys), np.int64)
                own[number] = runs
                if (own[number] == runs).all():
                    runs = own
                else:  # terms share a hash
                    runs, number = np.unique(runs, return_inverse=True)
                pair = number * (2**ROW_BITS) + np.concatenate(rows)
                pair.sort()
                total = np.bincount(number, minlength=len(runs))
                df = np.bincount(pair[_heads(pair)] >> ROW_BITS, minlength=len(runs))
                here = np.flatnonzero(total)
                runs, total, df = runs[here], total[here], df[here]
                digits = [runs // base ** (high - 1 - j) % base - 1 for j in range(high)]
                parts = [coded.dictionary.take(pa.array(d, mask=d < 0)) for d in digits]
                term = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                held.append(pa.table([term, pa.array(total, pa.int64()), pa.array(df, pa.int64())], ["term", "total", "df"]))
                held_rows += len(runs)
                if held_rows > SUMS_AT_ONCE:
                    held = [added(held)]
                    held_rows = held[0].num_rows
                    if held_rows > SUMS_AT_ONCE // 2:
                        yield from held.pop().to_batches()
                        held_rows = 0
        if held:
            yield from added(held).to_batches()

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by("term").aggregate([("total", "sum"), ("df", "sum")])
        return sums.select(["term", "total_sum", "df_sum"]).rename_columns(["term", "total", "df"]).combine_chunks()

    sums = counted.select("terms").mapInArrow(partial, "term string, total long, df long")
    return sums.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def frequent_stats(counted: DataFrame, spec: TfidfSpec, n: int) -> DataFrame:
    """``term_stats`` of the terms that can be in the vocabulary of *n* documents, as a written table.

    A hash occurs as often as its terms together, so a term is at most as frequent as its hash. The terms
    of the hashes that reach the last of the ``max_features`` most frequent are counted by their text. These are all that
    is needed if as many terms reach it; hashes that terms share could hide some, and then every term is counted.
    """
    (least, most), size = _bounds(spec, n), spec.max_features
    spark = counted.sparkSession
    with small_batches(spark), kept_for_now(_hash_sums(counted, spec, n), "hash-sums") as sums:
        # one row for each number of occurrences
        steps = sums.filter(F.col("df") <= most).groupBy("total").count().toArrow().sort_by([("total", "descending")])
        reach = np.cumsum(steps["count"].to_numpy())
        floor = int(steps["total"][int(np.searchsorted(reach, size))].as_py()) if len(reach) and reach[-1] >= size else 0
        keys = np.sort(sums.filter(F.col("total") >= floor).select("key").toArrow()["key"].to_numpy().astype(np.uint64))
    with small_batches(spark):
        stats = cut_lineage(_named_stats(counted, spec, keys), "term-sums")
    if floor and stats.filter((F.col("df") >= least) & (F.col("df") <= most) & (F.col("total") >= floor)).count() < size:
        return term_stats(counted, spec=spec)
    return stats


def kept_terms(stats: DataFrame, n: Column, spec: TfidfSpec) -> DataFrame:
    """The vocabulary of *n* documents whose terms have the given (term, total, df)."""

    def bound(value: int | float) -> Column:
        return F.lit(value) if isinstance(value, int) else F.lit(value) * n

    stats = stats.filter((F.col("df") >= bound(spec.min_df)) & (F.col("df") <= bound(spec.max_df)))
    stats = stats.orderBy(F.desc("total"), "term").limit(spec.max_features)
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    # The window sorts the kept vocabulary only, a size the spec sets.
    idx = F.row_number().over(W.orderBy("term")) - 1
    return stats.select("term", idx.alias("idx"), "df", idf.alias("idf"))


def vocabulary(counted: DataFrame, spec: TfidfSpec, rows: DataFrame | None = None) -> DataFrame:
    """(term, idx, df, idf): terms within the document-frequency bounds, the most frequent
    ``max_features`` of them (equal totals in term order), indexed in term order.

    *rows*, the documents behind *counted*, spares counting terms again just to count documents. Words
    are read twice, so *counted* had better be a written table.
    """
    docs = counted if rows is None else rows
    if _are_words(counted):
        n = docs.count()
        return kept_terms(frequent_stats(counted, spec, n), F.lit(n), spec)
    return kept_terms(term_stats(counted), docs.agg(F.count("*").alias("n")).scalar(), spec)


class Lookup:
    """A vocabulary in every task: at most the spec's ``max_features`` terms and their idf."""

    def __init__(self, vocab: DataFrame):
        table = vocab.select("term", "idx", "idf").toArrow().sort_by("idx")
        self.size = table.num_rows
        terms = table["term"].combine_chunks().cast(pa.string()) if self.size else pa.array([], pa.string())
        held = (terms, table["idf"].to_numpy().astype(np.float64), *_by_words(terms))
        self.held = vocab.sparkSession.sparkContext.broadcast(held)


def _by_words(terms: pa.Array) -> tuple[pa.Array, int, np.ndarray, np.ndarray]:
    """The words of *terms*, the words of the longest term, the terms as sorted numbers whose digits are words, and their places.

    Without numbers if they would be too long.
    """
    lists = pc.split_pattern(terms, " ")
    words, longest = lists.flatten().unique(), pc.max(pc.list_value_length(lists)).as_py() or 1
    base, key = len(words) + 1, np.zeros(len(terms), np.int64)
    if base**longest >= 2**62:
        return words, 0, key[:0], key[:0]
    row, code = pc.list_parent_indices(lists).to_numpy(), pc.index_in(lists.flatten(), value_set=words).to_numpy()
    place = np.arange(len(row)) - lists.offsets.to_numpy()[row]
    np.add.at(key, row, (code + 1) * base ** (longest - 1 - place))
    order = np.argsort(key)
    return words, longest, key[order], order


def _known_runs(words: pa.Array, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, tf) of the known terms among the runs of words of each row, in index order."""
    known, _, singles, longest, keys, place = held
    rows, terms, counts = [], [], []
    base = len(singles) + 1
    for at, some in _slices(words):
        row = pc.list_parent_indices(some).to_numpy()
        code = pc.index_in(some.flatten(), value_set=singles).fill_null(-1).to_numpy().astype(np.int64) + 1
        found = []
        for n in range(1, longest + 1):
            s = _run_starts(row, n)
            for j in range(n):
                s = s[code[s + j] > 0]
            key = sum(code[s + j] * base ** (longest - 1 - j) for j in range(n))
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[spot] == key
            found.append(row[s[hit]] * len(known) + place[spot[hit]])
        pair, tf = np.unique(np.concatenate(found), return_counts=True)
        rows.append(pair // len(known) + at)
        terms.append(pair % len(known))
        counts.append(tf)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, terms, counts))


def _known_terms(terms: pa.Array, held: tuple, ngrams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, tf) of the known terms of each row, in index order; *terms* may have been looked up already."""
    known, _, _, longest, _, _ = held
    if pa.types.is_struct(terms.type.value_type) and terms.type.value_type.field(0).name == "idx":
        idx, tf = terms.flatten().flatten()
        return pc.list_parent_indices(terms).to_numpy(), idx.to_numpy(), tf.to_numpy().astype(np.float64)
    words = not pa.types.is_struct(terms.type.value_type)
    if words and longest and len(known):
        row, idx, tf = _known_runs(terms, held)
        return row, idx.astype(np.int32), tf.astype(np.float64)
    if words:
        terms = pa.concat_arrays([_row_terms(some, *ngrams) for _, some in _slices(terms)] or [_row_terms(terms, *ngrams)])
    row = pc.list_parent_indices(terms).to_numpy()
    term, tf = terms.flatten().flatten()
    found = pc.index_in(term, value_set=known.cast(term.type))
    keep = found.is_valid().to_numpy(zero_copy_only=False)
    return row[keep], found.drop_null().to_numpy().astype(np.int32), tf.to_numpy()[keep].astype(np.float64)


def known_terms(df: DataFrame, lookup: Lookup, spec: TfidfSpec, terms: str = "terms") -> DataFrame:
    """*df* with *terms* looked up: (idx, tf) of the known ones, which is all that vectors need, in a tenth of their space."""
    held, ngrams = lookup.held, spec.ngrams

    def some(lists: pa.Array) -> pa.Array:
        row, idx, tf = _known_terms(lists, held.value, ngrams)
        entries = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), pa.array(tf.astype(np.int32))], names=["idx", "tf"])
        return pa.ListArray.from_arrays(_offsets(row, len(lists)), entries)

    @F.arrow_udf("array<struct<idx:int,tf:int>>")
    def found(lists: pa.Array) -> pa.Array:
        return _in_slices(some, lists, lists)

    return df.withColumn(terms, found(terms))


def _look_up(terms: pa.Array, held: tuple, sublinear: bool, ngrams: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, w) of the known terms of each row, in index order, L2 norm 1."""
    row, idx, tf = _known_terms(terms, held, ngrams)
    w = (np.log(tf) + 1 if sublinear else tf) * held[1][idx]
    norm = np.sqrt(np.bincount(row, w * w, minlength=len(terms)))
    return row, idx, w / norm[row] if len(row) else w


def _offsets(row: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32))


def weigh(counted: DataFrame, vocab: DataFrame, row_id: str, spec: TfidfSpec, *carry: str) -> DataFrame:
    """One row per document: ``weights``, array of (idx, term, w) in index order, L2 norm 1."""
    lookup = Lookup(vocab)
    held, sublinear, ngrams = lookup.held, spec.sublinear, spec.ngrams

    def some(terms: pa.Array) -> pa.Array:
        row, idx, w = _look_up(terms, held.value, sublinear, ngrams)
        names = held.value[0].take(pa.array(idx))
        entries = pa.StructArray.from_arrays([pa.array(idx, pa.int32()), names, pa.array(w)], names=["idx", "term", "w"])
        return pa.ListArray.from_arrays(_offsets(row, len(terms)), entries)

    @F.arrow_udf("array<struct<idx:int,term:string,w:double>>")
    def weights(terms: pa.Array) -> pa.Array:
        return _in_slices(some, terms, terms)

    return counted.select(row_id, *carry, weights("terms").alias("weights"))


def long_weights(counted: DataFrame, vocab: DataFrame, row_id: str, spec: TfidfSpec) -> DataFrame:
    """(row_id, term, x): a row for each weight of ``weigh``, a slice of documents at a time."""
    lookup = Lookup(vocab)
    held, sublinear, ngrams = lookup.held, spec.sublinear, spec.ngrams
    names = ["_id", "_term", "_x"]
    source = counted.select(F.col(row_id).alias(names[0]), "terms")
    schema = StructType([source.schema[names[0]], *StructType.fromDDL("_term string, _x double").fields])

    def rows(batches):
        for batch in batches:
            for at, lists in _slices(batch.column(1)):
                row, idx, w = _look_up(lists, held.value, sublinear, ngrams)
                columns = [batch.column(0).slice(at).take(pa.array(row)), held.value[0].take(pa.array(idx)), pa.array(w)]
                yield pa.record_batch(columns, names)

    return source.mapInArrow(rows, schema).select(F.col("_id").alias(row_id), F.col("_term").alias("term"), F.col("_x").alias("x"))


def tfidf(df: DataFrame, row_id: str, text: str, spec: TfidfSpec = PRESETS["classifier"]) -> DataFrame:
    """Fit and transform in one: long (row_id, term, tfidf)."""
    counted = cut_lineage(term_counts(df, row_id, text, spec), "words")
    long = long_weights(counted, vocabulary(counted, spec), row_id, spec)
    return long.select(row_id, "term", round_even(F.col("x"), 6).alias("tfidf"))


def _vectors(row: np.ndarray, idx: np.ndarray, w: np.ndarray, n: int, size: int) -> pa.Array:
    """Sparse vectors in their storage form, from entries in any order."""
    order = np.lexsort((idx, row))
    row, idx, w = row[order], idx[order].astype(np.int32), w[order]
    offsets = _offsets(row, n)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (idx, w)]
    head = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32))]
    return pa.StructArray.from_arrays([*head, *lists], names=["type", "size", "indices", "values"])


def row_vector(
    df: DataFrame,
    lookup: Lookup,
    spec: TfidfSpec,
    numeric: Sequence[str] = (),
    codes: dict[str, list[str]] | None = None,
    terms: str = "terms",
    out: str = "features",
) -> DataFrame:
    """*df* with one sparse vector: the text block, the numeric columns, a slot for each category in *codes*.

    A null number is 0; a null or unknown category has no slot set. Everything happens inside the row.
    """
    codes = codes or {}
    held, sublinear, ngrams, k = lookup.held, spec.sublinear, spec.ngrams, len(numeric)
    tables = [pa.array(v, pa.string()) for v in codes.values()]
    bases = np.cumsum([lookup.size + k, *map(len, tables)]).tolist()

    def some(rows: pa.Array) -> pa.Array:
        terms, numbers, names = rows.flatten()
        n = len(rows)
        parts = [_look_up(terms, held.value, sublinear, ngrams)]
        if k:
            values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            at = np.nonzero(values)
            parts.append((at[0], at[1] + len(held.value[0]), values[at]))
        if tables:
            flat = names.flatten()
            place = np.arange(len(flat))
            for i, table in enumerate(tables):
                code = pc.index_in(flat.take(pa.array(place[i :: len(tables)])), value_set=table, skip_nulls=True)
                has = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                parts.append((has, code.drop_null().to_numpy() + bases[i], np.ones(len(has))))
        row, idx, w = (np.concatenate(x) for x in zip(*parts))
        return _vectors(row, idx, w, n, bases[-1])

    @F.arrow_udf(VectorUDT())
    def vectors(rows: pa.Array) -> pa.Array:
        return _in_slices(some, rows, rows.flatten()[0])

    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]).cast("array<double>")
    names = F.array(*[F.col(c).cast("string") for c in codes]).cast("array<string>")
    return df.withColumn(out, vectors(F.struct(F.col(terms).alias("t"), numbers.alias("n"), names.alias("c"))))


def feature_vector(weighed: DataFrame, size: int, extra: Sequence[str] = (), out: str = "features") -> DataFrame:
    """Assemble text weights and numeric columns (after the text block) into one sparse vector."""
    k = len(extra)

    @F.arrow_udf(VectorUDT())
    def vectors(rows: pa.Array) -> pa.Array:
        weights, numbers = rows.flatten()
        idx, _, w = weights.flatten().flatten()
        values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), k)
        at = np.nonzero(values)
        row = np.concatenate((pc.list_parent_indices(weights).to_numpy(), at[0]))
        return _vectors(row, np.concatenate((idx.to_numpy(), at[1] + size)), np.concatenate((w.to_numpy(), values[at])), len(rows), size + k)

    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extra]).cast("array<double>")
    return weighed.withColumn(out, vectors(F.struct("weights", numbers.alias("n")))).drop("weights")


def categories(df: DataFrame, col: str, missing: str = "unknown") -> DataFrame:
    """(category, code): distinct values in order. One row per category goes through the window."""
    values = df.select(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("category")).distinct()
    return values.withColumn("code", F.row_number().over(W.orderBy("category")) - 1)


def ordinal_encode(df: DataFrame, col: str, codes: DataFrame, out: str, missing: str = "unknown") -> DataFrame:
    """Code of the category, -1 for one never seen."""
    key = F.coalesce(F.col(col).cast("string"), F.lit(missing))
    table = codes.select(F.col("category").alias("_cat"), F.col("code").alias(out))
    return (
        df.withColumn("_key", key)
        .join(table, F.col("_key") == F.col("_cat"), "left")
        .withColumn(out, F.coalesce(F.col(out), F.lit(-1)))
        .drop("_key", "_cat")
    )


def label_decode(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    table = codes.select(F.col("code").alias(col), F.col("category").alias(out))
    return df.join(table, col, "left")


def one_hot(df: DataFrame, col: str, codes: DataFrame, out: str) -> DataFrame:
    """Array of 0/1 per category in code order; all zero for a category never seen."""
    names = codes.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("code", "category"))), lambda e: e["category"]).alias("n")
    )
    key = F.coalesce(F.col(col).cast("string"), F.lit("unknown"))
    df = df.withColumn("_names", names.scalar())
    return df.withColumn(out, F.transform("_names", lambda c: (c == key).cast("int"))).drop("_names")


def numeric_features(df: DataFrame) -> DataFrame:
    """Citations (absent or null counts 0), year and text length as doubles."""
    cites = F.coalesce(F.col("num_citations").cast("double"), F.lit(0.0)) if "num_citations" in df.columns else F.lit(0.0)
    return df.withColumns(
        {
            "f_citations": cites,
            "f_year": F.coalesce(F.col("year").try_cast("double"), F.lit(0.0)),
            "f_text_length": F.length("case_text").cast("double"),
        }
    )


def scale(df: DataFrame, col: str, how: str = "zscore", out: str | None = None) -> DataFrame:
    """z-score (population deviation), ``variance`` (no centring) or ``maxabs``."""
    c = F.col(col).cast("double")
    facts = df.agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(F.abs(c)).alias("top")
    )
    mean = facts.select("mean").scalar()
    spread = facts.select(F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("s")).scalar()
    top = facts.select(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("t")).scalar()
    scaled = {"zscore": (c - mean) / spread, "variance": c / spread, "maxabs": c / top}[how]
    return df.withColumn(out or col, scaled)
