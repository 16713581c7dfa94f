"""Substring dedup by seed and extend.

Seeds: of the 8-word grams of every 20-word window the least-hashed one is an anchor
(winnowing), so equal windows share an anchor at the same place in them. Documents meet
on anchors. A meeting is extended word by word to the left and to the right, 12 words at
most, since no window around the anchor reaches further; what matches is a maximal repeat,
and is removed from the later text if it has 20 words or more.

The occurrences of an anchor are not compared all with all. Those whose 32 words around the
anchor are the same need no further comparison: all but the first lose the whole stretch. The
firsts of different stretches are extended against the earliest of them; those that part from it
at the same word, going on with the same word, have a longer seed in common and meet again among
themselves, until every window has met the earliest equal one.

Scale: the scan writes its anchors once; they are counted by partial aggregation, and only
repeated ones meet. Counts and first places are aggregated before they move, and a seed in a third of
all texts meets them in joins that split skewed keys. Seeds with more different stretches than a task
should hold (GROUP, or a millionth of all, so that their number is bounded and they can be broadcast)
are split by longer seeds, at last by the window itself, which is aggregated. Texts move twice, once to
the open anchors and once to the removals; documents without any are left out by their keys where these
are few enough to broadcast (FEW), else by the join. Tables are deleted when their last reader is done.

Order: smaller doc_id first, rows without one last; rows of one id as they are read. Words are
compared by 64-bit hashes, a stretch by 112 bits, whole texts by MD5.
Defined results: a null or empty text has no words; texts under 20 words lose nothing; of equal
rows the first keeps what is unique in it and the others lose all; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.arrays import U, mix, slices, window_hashes, word_bounds, word_hashes
from casework.llm.seeds import PLACE, bring, keyed_texts, list_array, meet, raw_bytes
from casework.llm.shared import Tables

LENGTH = 20
SEED = 8
REACH = LENGTH - SEED  # words that a window can have on either side of its seed
PIECE = 1 << 19  # grams that are searched for anchors at a time
SHARE, GROUP = 1_000_000, 20_000  # a group is crowded with more than this share of all stretches, and more than so many
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(grams: np.ndarray) -> np.ndarray:
    """Places of the least gram (the first of equals) of every REACH + 1 neighbours."""
    width, out = REACH + 1, []
    for begin in range(0, max(len(grams) - REACH, 0), PIECE):
        part = grams[begin : begin + PIECE + REACH]
        m = len(part)
        key = part & ~U((1 << 20) - 1) | np.arange(m).astype(U)
        padded = np.full(-(-m // width) * width, ~U(0))
        padded[:m] = key
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: m - REACH], before[REACH:m]) & U((1 << 20) - 1)
        out.append(begin + least.astype(np.int64))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def stretches(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the words that the windows around each anchor span, and of where the text cuts them."""
    padded = np.concatenate((np.zeros(REACH, U), words, np.zeros(REACH, U)))
    total = np.zeros(len(at), U)
    for j in range(2 * REACH + SEED):
        total = total * U(0x9E3779B97F4A7C15) + padded[at + j]
    left, right = np.minimum(at, REACH), np.minimum(len(words) - at - SEED, REACH)
    return mix(total + mix((left * 64 + right + 1).astype(U)))


def joined_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(texts: DataFrame) -> DataFrame:
    """One row per document: id, no_id, d, n, sha and its anchors (seed, stretch, place)."""
    names = ["id", "no_id", "d", "n", "sha", "seeds", "stretches", "places"]
    schema = "id long, no_id boolean, d binary, n long, sha string, seeds array<long>, stretches array<long>, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole.column(3)):
                batch = whole.slice(begin, end - begin)
                counts, shas, seeds, spans, places = [], [], [], [], []
                for text in batch.column(3):
                    raw = raw_bytes(text)
                    split = raw.split()
                    counts.append(len(split))
                    shas.append(joined_sha(split))
                    found = (np.zeros(0, np.int64),) * 3
                    if len(split) >= LENGTH:
                        data = np.frombuffer(raw, np.uint8)
                        words = word_hashes(data, *word_bounds(data))
                        grams = window_hashes(words, SEED)
                        at = anchors(grams)
                        found = (grams[at] >> U(16)).view(np.int64), stretches(words, at).view(np.int64), at
                    for parts, part in zip((seeds, spans, places), found):
                        parts.append(part)
                lists = [list_array(seeds, pa.int64()), list_array(spans, pa.int64()), list_array(places, pa.int32())]
                head = [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays([*head, *lists], names=names)

    return texts.select("id", "no_id", "d", "text").mapInArrow(run, schema)


def _contexts(brought: DataFrame) -> DataFrame:
    """(key, lo, hi, id, uid, p, left, context): the words that the windows around an open anchor span."""
    names = ["key", "lo", "hi", "id", "uid", "p", "left", "context"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, uid, text, found in zip(*batch.columns):
                raw = raw_bytes(text)
                starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
                rows = []
                for x in found.as_py():
                    p = x["p"]
                    left, stop = min(p, REACH), min(p + SEED + REACH, len(starts))
                    context = raw[starts[p - left] : ends[stop - 1]]
                    rows.append((x["h"], 0, REACH, i.as_py(), uid.as_py(), p, left, context))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "key long, lo int, hi int, id long, uid long, p int, left int, context binary"
    return brought.select("id", "uid", "text", "found").mapInArrow(run, schema)


def word_matrix(contexts: list[bytes], left: np.ndarray) -> np.ndarray:
    """Word hashes of each context, the seed in the columns REACH to REACH + SEED; where the text ends, values that equal nothing."""
    width = 2 * REACH + SEED
    out = mix(np.arange(len(contexts) * width).astype(U) + U(1 << 63)).reshape(len(contexts), width)
    data = np.frombuffer(b" ".join(contexts), np.uint8)
    starts, ends = word_bounds(data)
    edges = np.cumsum([0, *(len(c) + 1 for c in contexts)])
    firsts = np.searchsorted(starts, edges)
    row = np.repeat(np.arange(len(contexts)), np.diff(firsts))
    column = np.arange(len(starts)) - firsts[row] + REACH - left[row]
    out[row, column] = word_hashes(data, starts, ends)
    return out


def _agree(equal: np.ndarray) -> np.ndarray:
    """How many leading columns are true."""
    differs = ~equal
    return np.where(differs.any(axis=1), differs.argmax(axis=1), equal.shape[1])


def extend(words: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of LENGTH words or more with earlier rows: (row, words to the left, words to the right of the seed).

    Rows of one key stand in the order of documents. A window is known by the number of its words right of
    the seed; *lo* to *hi* are those still to be met. Each round extends the rows of a group against its
    first. What reaches beyond the match goes on with the rows that leave it at the same word.
    """
    seed = window_hashes(words[:, REACH : REACH + SEED].ravel(), SEED)[::SEED] if len(words) else keys
    rows, side, where, word, group = np.arange(len(words)), np.zeros(len(words), np.int64), lo, seed, keys
    found: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        order = np.lexsort((rows, word, where, side, group))
        rows, side, where, word, group, lo, hi = (x[order] for x in (rows, side, where, word, group, lo, hi))
        new = np.ones(len(rows), bool)
        new[1:] = (word[1:] != word[:-1]) | (where[1:] != where[:-1]) | (side[1:] != side[:-1]) | (group[1:] != group[:-1])
        label = np.cumsum(new) - 1
        rest = np.flatnonzero(~new)
        if not len(rest):
            break
        centre, own, label = rows[np.flatnonzero(new)[label[rest]]], rows[rest], label[rest]
        lo, hi = lo[rest], hi[rest]
        equal = words[own] == words[centre]
        right, left = _agree(equal[:, REACH + SEED :]), _agree(equal[:, REACH - 1 :: -1])
        long = left + right >= REACH
        found.append((own[long], left[long], right[long]))
        parts = []
        for which, distance, low, high in ((1, right, np.maximum(lo, right + 1), hi), (0, left, lo, np.minimum(np.minimum(hi, right), REACH - 1 - left))):
            go = np.flatnonzero(low <= high)
            column = (REACH + SEED + distance if which else REACH - 1 - distance)[go]
            parts.append((own[go], np.full(len(go), which), distance[go], words[own[go], column], label[go], low[go], high[go]))
        rows, side, where, word, group, lo, hi = (np.concatenate(x) for x in zip(*parts))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((),) * 3))


def _repeats(grouped: DataFrame) -> DataFrame:
    """(uid, begin, end) of the maximal repeats, from rows that are grouped by key and ordered in it."""

    def spans(held: pa.Table) -> pa.RecordBatch:
        held = held.combine_chunks()
        column = lambda name: held[name].to_numpy()
        words = word_matrix(held["context"].to_pylist(), column("left"))
        lo, hi = column("lo").astype(np.int64), column("hi").astype(np.int64)
        row, left, right = extend(words, column("key"), lo, hi)
        uid, p = column("uid")[row], column("p")[row]
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(p - left, pa.int64()), pa.array(p + SEED + right, pa.int64())], names=["uid", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for begin, end in slices(whole.column(6)):
                batch = whole.slice(begin, end - begin)
                keys = batch.column(0).to_numpy()
                change = np.flatnonzero(keys[1:] != keys[:-1])
                last = int(change[-1]) + 1 if len(change) else 0
                if held and keys[0] != held[-1].column(0)[-1].as_py() and not last:
                    yield spans(pa.Table.from_batches(held))
                    held = []
                if last:
                    yield spans(pa.Table.from_batches([*held, batch.slice(0, last)]))
                    held = []
                held.append(batch.slice(last))
        if held:
            yield spans(pa.Table.from_batches(held))

    return grouped.select("key", "lo", "hi", "uid", "p", "left", "context").mapInArrow(run, "uid long, begin long, end long")


def _longer_seeds(rows: DataFrame) -> DataFrame:
    """The rows of crowded groups under two longer seeds, each for one half of the windows."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lo, hi, left = (batch.column(names.index(n)).to_numpy().astype(np.int64) for n in ("lo", "hi", "left"))
            words = word_matrix(batch.column(names.index("context")).to_pylist(), left)
            middle = (lo + hi) // 2
            for a, b in ((lo, middle), (middle + 1, hi)):
                # windows with a to b words on the right share the words from REACH - b before the seed to a after it
                span = np.arange(words.shape[1])
                inside = (span >= b[:, None]) & (span < (REACH + SEED + a)[:, None])
                total = np.zeros(len(words), U)
                for j in span:
                    total = np.where(inside[:, j], total * U(0x9E3779B97F4A7C15) + words[:, j], total)
                key = mix(total + mix((a * 64 + b + 1).astype(U))).view(np.int64)
                columns = {"key": pa.array(key), "lo": pa.array(a, pa.int32()), "hi": pa.array(b, pa.int32())}
                yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

    return rows.mapInArrow(run, rows.schema)


def _extended(tables: Tables, contexts: DataFrame) -> DataFrame:
    """Spans (uid, begin, end) that repeat an earlier window around an open anchor."""
    limit = max(GROUP, contexts.count() // SHARE)
    out, depth = [], 0
    while True:
        sizes = contexts.groupBy("key", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
        crowded = tables.keep(f"crowded-{depth}", sizes.where((F.col("n") > limit) & (F.col("lo") < F.col("hi"))).select("key"))
        single = F.col("lo") == F.col("hi")
        grouped = contexts.where(~single).join(F.broadcast(crowded), "key", "left_anti")
        grouped = grouped.repartition("key").sortWithinPartitions("key", "lo", *PLACE)
        out.append(_repeats(grouped))
        # a seed of LENGTH words is the window itself: only its first occurrence matters
        windows = contexts.where(single)
        firsts = windows.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("least"))
        again = windows.join(firsts, "key").where(F.struct(*PLACE) != F.col("least"))
        begin = (F.col("p") - REACH + F.col("lo")).cast("long")
        if depth:
            out.append(again.select("uid", begin.alias("begin"), (begin + LENGTH).alias("end")))
        if crowded.isEmpty():
            break
        depth += 1
        contexts = tables.keep(f"contexts-{depth}", _longer_seeds(contexts.join(F.broadcast(crowded), "key", "left_semi")))
    spans = out[0]
    for more in out[1:]:
        spans = spans.union(more)
    return spans


def _remove(brought: DataFrame) -> DataFrame:
    """(uid, n_removed, kept_sha): each text without its covered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, text, spans in zip(*batch.columns):
                words = raw_bytes(text).split()
                ends = spans.values.field("end").to_numpy()
                begins = spans.values.field("begin").to_numpy()
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, np.maximum(begins, 0), 1)
                np.add.at(step, np.minimum(ends, len(words)), -1)
                gone = np.cumsum(step[:-1]) > 0
                rows.append((uid.as_py(), int(gone.sum()), joined_sha([words[i] for i in np.flatnonzero(~gone)])))
            columns = zip(*rows) if rows else ((),) * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "n_removed", "kept_sha"])

    return brought.select("uid", "text", "spans").mapInArrow(run, "uid long, n_removed long, kept_sha string")


def remove_substrings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    tables = Tables(docs.sparkSession, "substrings")
    texts = keyed_texts(docs, id_column, text_column)
    scan = tables.keep("scan", _scan(texts).withColumn("uid", F.monotonically_increasing_id()))
    rows = tables.keep("rows", scan.select("uid", "id", "no_id", "d", "n", "sha"))
    anchor = F.inline(F.arrays_zip("seeds", "stretches", "places")).alias("h", "w", "p")
    met = meet(tables, scan.select("id", "uid", anchor))
    tables.drop("scan")
    found = met.where("first AND kinds > 1").groupBy("uid").agg(F.collect_list(F.struct("h", "p")).alias("found"))
    wanted = tables.keep("open", found.join(rows.select("uid", "id", "d"), "uid"))
    contexts = tables.keep("contexts", _contexts(bring(texts, wanted)))
    same = met.where("NOT first").select("uid", (F.col("p") - REACH).cast("long").alias("begin"), (F.col("p") + SEED + REACH).cast("long").alias("end"))
    firsts = rows.where(F.col("n") >= LENGTH).groupBy("d").agg(F.min(F.struct("id", "uid")).alias("least"))
    judged = rows.join(firsts, "d", "left").withColumn("copy", F.coalesce(F.col("least.uid") != F.col("uid"), F.lit(False))).drop("least")
    judged = tables.keep("judged", judged)
    covered = same.union(_extended(tables, contexts)).groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    spans = tables.keep("spans", covered.join(judged.where(~F.col("copy")).select("uid", "id", "d"), "uid"))
    tables.drop("rows", "met", "open", *[name for name in tables.paths if name.startswith(("contexts", "crowded"))])
    removed = tables.keep("removed", _remove(bring(texts, spans)))
    tables.drop("spans")
    out = judged.join(removed, "uid", "left")
    pick = lambda all_gone, some: F.when(F.col("copy"), all_gone).otherwise(some)
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n").alias("n_words"),
        pick(F.col("n"), F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        pick(F.lit(EMPTY), F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
