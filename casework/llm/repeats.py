"""Repeated strings by depth-limited radix passes.

The suffixes of all texts are compared through their first ``length`` bytes only, in passes that each
look further; groups of equal suffixes that a pass leaves with one member drop out, and groups that are
equal through the depth are exactly the repeated strings.

Departures from the plain form, because a row for each byte would be 20 times the input: neighbouring
suffixes are moved together, and passes compare digests of the next bytes, so that groups are formed
but not put in byte order. The first digit of a suffix is the least-hashed 58-byte string inside its
first 400 bytes, at its place (an anchor): equal suffixes have it in common, and all suffixes around one
anchor are one run of 343 starts. A pass compares what all starts of a run share (its core; unique means
that no start is repeated) and what they span (its whole; equal means that every start is repeated).
What is neither is cut into seven runs with longer cores, so that three more passes reach single suffixes.

Scale: the scan writes its anchors once; cores are counted by partial aggregation, and only repeated
ones meet, in joins that split skewed keys. Of equal wholes the first goes on for the others, with the
742 bytes of its context, to the task that holds its core; there the passes go on in memory. Cores with
more wholes than a task should hold (GROUP, or a millionth of all, so that their number is bounded and
they can be broadcast) are cut by a pass over all tasks first, at last to single suffixes, which are
counted. Texts move twice, once to the open anchors and once to the removals. Tables are deleted when
their last reader is done.

Equality of strings rests on two 64-bit hashes, of texts on their MD5.
Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing;
repeated rows are each other's copies and lose everything from ``length`` bytes on, whether their id is
null, the same or not; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.arrays import U, mix, powers, prefix_hash, range_hash, slices
from casework.llm.seeds import bring, keyed_texts, list_array, meet, raw_bytes
from casework.llm.shared import Tables

LENGTH = 400
CUTS = 7
STARTS = CUTS**3  # starts of one run
GRAM = LENGTH - STARTS + 1  # bytes that all of them share
PIECE = 1 << 19  # bytes of a text that are searched for anchors at a time
SHARE, GROUP = 1_000_000, 4000  # a core is crowded with more than this share of all wholes, and more than so many
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(data: np.ndarray) -> np.ndarray:
    """Places of the least-hashed gram (the first of equals) of every window of LENGTH bytes."""
    out = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
        part = data[begin : begin + PIECE + LENGTH - 1]
        h, inverse = prefix_hash(part), powers(len(part) + 1)[1]
        m = len(part) - GRAM + 1
        key = mix((h[GRAM:] - h[:-GRAM]) * inverse[:m]) & ~U((1 << 20) - 1) | np.arange(m).astype(U)
        # the smallest of every STARTS neighbours from running minima of blocks
        padded = np.full(-(-m // STARTS) * STARTS, ~U(0))
        padded[:m] = key
        blocks = padded.reshape(-1, STARTS)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = m - STARTS + 1
        place = (np.minimum(after[:windows], before[STARTS - 1 : m]) & U((1 << 20) - 1)).astype(np.int64)
        out.append(begin + place[np.concatenate(([True], place[1:] != place[:-1]))])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _scan(texts: DataFrame) -> DataFrame:
    """One row per document: id, no_id, d, n, sha and its anchors (core, whole, place)."""
    names = ["id", "no_id", "d", "n", "sha", "cores", "wholes", "places"]
    schema = "id long, no_id boolean, d binary, n long, sha string, cores array<long>, wholes array<long>, places array<int>"

    def found(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = anchors(data)
        if not len(at):
            return at, at, at
        low, high = np.maximum(at - STARTS + 1, 0), np.minimum(at + LENGTH, len(data))
        core = range_hash(prefix_hash(data), at, at + GRAM)
        whole = range_hash(prefix_hash(data, 1), low, high, 1)
        # where the text ends inside the run, only runs that end alike are equal
        whole = mix(whole + mix(((at - low) * 1024 + high - at).astype(U)))
        return core.view(np.int64), whole.view(np.int64), at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole.column(3)):
                batch = whole.slice(begin, end - begin)
                raws = [raw_bytes(t) for t in batch.column(3)]
                lists = zip(*(found(np.frombuffer(r, np.uint8)) for r in raws))
                kinds = (pa.int64(), pa.int64(), pa.int32())
                head = [
                    *batch.columns[:3],
                    pa.array([len(r) for r in raws], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*head, *(list_array(x, k) for x, k in zip(lists, kinds))], names=names)

    return texts.select("id", "no_id", "d", "text").mapInArrow(run, schema)


ROW = {"key": "long", "key2": "long", "c": "int", "width": "int", "uid": "long", "p": "int", "left": "int", "context": "binary"}
ROW_SCHEMA = ", ".join(f"{n} {t}" for n, t in ROW.items())
ROW_KINDS = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t] for t in ROW.values()]


def _contexts(brought: DataFrame) -> DataFrame:
    """A row (ROW) for each open anchor: the run of *width* starts from the *c*th around the anchor at p, and its bytes.

    *left*: bytes of the context before the anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text, found in zip(*batch.columns):
                raw, rows = raw_bytes(text), []
                for x in found.as_py():
                    low = max(x["p"] - STARTS + 1, 0)
                    rows.append((x["h"], 0, 0, STARTS, uid.as_py(), x["p"], x["p"] - low, raw[low : x["p"] + LENGTH]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), ROW_KINDS)], names=list(ROW))

    return brought.select("uid", "text", "found").mapInArrow(run, ROW_SCHEMA)


class Runs:
    """Hashes of the runs inside some contexts."""

    def __init__(self, contexts: list[bytes], left: np.ndarray):
        self.left = left.astype(np.int64)
        self.size = np.array([len(c) for c in contexts], np.int64)
        width = int(self.size.max(initial=0))
        data = np.zeros((len(contexts), width), np.uint8)
        data[np.arange(width) < self.size[:, None]] = np.frombuffer(b"".join(contexts), np.uint8)
        self.sums, self.inverse = [], []
        for which in (0, 1):
            power, inverse = powers(width + 1, which)
            total = np.zeros((len(contexts), width + 1), U)
            np.cumsum((data.astype(U) + U(1)) * power[:width], axis=1, out=total[:, 1:])
            self.sums.append(total)
            self.inverse.append(inverse)

    def hashes(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix((h[rows, end] - h[rows, start]) * inverse[start]) for h, inverse in zip(self.sums, self.inverse)]

    def limits(self, rows: np.ndarray, c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the run's first start, and of the first and last start whose string lies in the text."""
        start = self.left[rows] - (STARTS - 1) + c
        return start, np.maximum(start, 0), np.minimum(start + width - 1, self.size[rows] - LENGTH)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each row's group, whether it is the first in it, and the group's size."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.empty(len(order), bool)
    first[order] = new
    return number, first, np.bincount(number)[number] if len(order) else number


def passes(runs: Runs, keys: np.ndarray, c: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end in its context) of the runs that are repeated in every start; *keys* are the groups of the rows."""
    rows, label = np.arange(len(keys)), keys
    out: list[tuple[np.ndarray, ...]] = []
    while len(rows):
        start, low, high = runs.limits(rows, c, width)
        some = low <= high
        rows, c, label, start, low, high = (x[some] for x in (rows, c, label, start, low, high))
        label, _, size = groups(*runs.hashes(rows, start + width - 1, start + LENGTH), c, label)
        shared = size > 1
        rows, c, label, start, low, high = (x[shared] for x in (rows, c, label, start, low, high))
        _, first, alike = groups(*runs.hashes(rows, low, high + LENGTH), low - start, high - start, label)
        done = alike > 1
        out.append((rows[done], low[done], high[done] + LENGTH))
        if width == 1:
            break
        # of equal wholes the first goes on, to meet the parts of other wholes
        rows, c, label = rows[first], c[first], label[first]
        if len(rows):
            several = np.bincount(label)[label] > 1
            rows, c, label = rows[several], c[several], label[several]
        width //= CUTS
        c = (c[:, None] + width * np.arange(CUTS)).ravel()
        rows, label = np.repeat(rows, CUTS), np.repeat(label, CUTS)
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _within(grouped: DataFrame) -> DataFrame:
    """(uid, begin, end) of the repeated runs, from rows of one width that are grouped by key."""

    def spans(held: pa.Table) -> pa.RecordBatch:
        held = held.combine_chunks()
        column = lambda name: held[name].to_numpy()
        runs = Runs(held["context"].to_pylist(), column("left"))
        row, begin, end = passes(runs, column("key"), column("c").astype(np.int64), int(column("width")[0]))
        shift = column("p")[row] - runs.left[row]
        return pa.RecordBatch.from_arrays([pa.array(column("uid")[row]), pa.array(shift + begin), pa.array(shift + end)], names=["uid", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for begin, end in slices(whole.column(7), 1_500_000):
                batch = whole.slice(begin, end - begin)
                keys = batch.column(0).to_numpy()
                change = np.flatnonzero(keys[1:] != keys[:-1])
                last = int(change[-1]) + 1 if len(change) else 0
                if held and not last and keys[0] != held[-1].column(0)[-1].as_py():
                    yield spans(pa.Table.from_batches(held))
                    held = []
                if last:
                    yield spans(pa.Table.from_batches([*held, batch.slice(0, last)]))
                    held = []
                held.append(batch.slice(last))
        if held:
            yield spans(pa.Table.from_batches(held))

    return grouped.mapInArrow(run, "uid long, begin long, end long")


def _cut(rows: DataFrame) -> DataFrame:
    """The runs of crowded groups cut into CUTS, each under its own core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole.column(7), 1_500_000):
                batch = whole.slice(begin, end - begin)
                contexts = batch.column(7).to_pylist()
                runs = Runs(contexts, batch.column(6).to_numpy())
                width = int(batch.column(3)[0].as_py()) // CUTS
                for j in range(CUTS):
                    c = batch.column(2).to_numpy().astype(np.int64) + j * width
                    start, low, high = runs.limits(np.arange(len(c)), c, width)
                    some = np.flatnonzero(low <= high)
                    if not len(some):
                        continue
                    first, second = runs.hashes(some, start[some] + width - 1, start[some] + LENGTH)
                    key = mix(first + c[some].astype(U)).view(np.int64)
                    pieces = [contexts[i][low[i] : high[i] + LENGTH] for i in some.tolist()]
                    taken = batch.take(pa.array(some))
                    columns = [key, second.view(np.int64), c[some], np.full(len(some), width), taken.column(4), taken.column(5), (runs.left - low)[some], pieces]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, ROW_KINDS)], names=list(ROW))

    return rows.mapInArrow(run, ROW_SCHEMA)


def _inside(tables: Tables, rows: DataFrame) -> DataFrame:
    """Spans (uid, begin, end) of repeated strings around open anchors."""
    limit = max(GROUP, rows.count() // SHARE)
    out, width = [], STARTS
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        crowded = tables.keep(f"crowded-{width}", sizes.where(F.col("n") > limit).select("key"))
        calm = rows.join(F.broadcast(crowded), "key", "left_anti").select(*ROW)
        out.append(_within(calm.repartition("key").sortWithinPartitions("key")))
        if crowded.isEmpty():
            break
        width //= CUTS
        rows = tables.keep(f"rows-{width}", _cut(rows.join(F.broadcast(crowded), "key", "left_semi").select(*ROW)))
        if width == 1:
            # a core of one start is the string itself
            again = rows.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            begin = (F.col("p") - (STARTS - 1) + F.col("c")).cast("long")
            out.append(rows.join(again, ["key", "key2"]).select("uid", begin.alias("begin"), (begin + LENGTH).alias("end")))
            break
    spans = out[0]
    for more in out[1:]:
        spans = spans.union(more)
    return spans


def _remove(brought: DataFrame) -> DataFrame:
    """(uid, n_removed, n_spans, kept_sha): each text without its covered bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uid, text, spans in zip(*batch.columns):
                data = np.frombuffer(raw_bytes(text), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, np.maximum(spans.values.field("begin").to_numpy(), 0), 1)
                np.add.at(step, np.minimum(spans.values.field("end").to_numpy(), len(data)), -1)
                gone = np.cumsum(step[:-1]) > 0
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((uid.as_py(), int(gone.sum()), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            columns = zip(*rows) if rows else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "n_removed", "n_spans", "kept_sha"])

    return brought.select("uid", "text", "spans").mapInArrow(run, "uid long, n_removed long, n_spans long, kept_sha string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    tables = Tables(docs.sparkSession, "repeats")
    texts = keyed_texts(docs, id_column, text_column)
    scan = tables.keep("scan", _scan(texts).withColumn("uid", F.monotonically_increasing_id()))
    rows = tables.keep("rows", scan.select("uid", "id", "no_id", "d", "n", "sha"))
    anchor = F.inline(F.arrays_zip("cores", "wholes", "places")).alias("h", "w", "p")
    met = meet(tables, scan.select("id", "uid", anchor))
    tables.drop("scan")
    found = met.where("first AND kinds > 1").groupBy("uid").agg(F.collect_list(F.struct("h", "p")).alias("found"))
    wanted = tables.keep("open", found.join(rows.select("uid", "id", "d"), "uid"))
    contexts = tables.keep("contexts", _contexts(bring(texts, wanted)))
    copies = rows.where(F.col("n") >= LENGTH).groupBy("d").agg(F.count(F.lit(1)).alias("copies"))
    judged = rows.join(copies, "d", "left").withColumn("copy", F.coalesce(F.col("copies") > 1, F.lit(False))).drop("copies")
    judged = tables.keep("judged", judged)
    same = met.where("alike > 1").select("uid", (F.col("p") - STARTS + 1).cast("long").alias("begin"), (F.col("p") + LENGTH).cast("long").alias("end"))
    covered = same.union(_inside(tables, contexts)).groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    spans = tables.keep("spans", covered.join(judged.where(~F.col("copy")).select("uid", "id", "d"), "uid"))
    tables.drop("rows", "met", "open", *[n for n in tables.paths if n.startswith(("contexts", "crowded", "rows-"))])
    removed = tables.keep("removed", _remove(bring(texts, spans)))
    tables.drop("spans")
    out = judged.join(removed, "uid", "left")
    pick = lambda all_gone, some: F.when(F.col("copy"), all_gone).otherwise(some)
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        pick(F.col("n"), F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        pick(F.lit(1).cast("long"), F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        pick(F.lit(EMPTY), F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )
