"""N-gram Jaccard join by PartEnum signatures.

A document is the set of hashes of its word shingles. Two documents link when their
Jaccard similarity reaches a percentage. Sizes fall into bands; sets of linkable
sizes share the instance of the larger one's band, in which their sets differ in at
most k elements. An instance splits the domain of hashes into ranges. For small k
it enumerates the ways to leave out k ranges, so that linked sets agree on one of the
unions that remain; for larger k it has more ranges than differences, so that linked
sets agree on single ranges. A signature is the instance, the subset and the hash of
what the set has there; linked sets always share one. Candidates are then
compared by exact set sizes.

How it holds at scale:

- Signatures leave a task packed: for each bucket of the signature space one row with
  the sorted signatures of many documents. Within a task a set is sent once, so that
  a third of all rows being copies sends as many rows as there are tasks.
- A signature of up to COLD sets gives all pairs. More frequent ones ("hot") are
  needed only for sets that have few others: a linked pair agrees on more ranges than
  a set has hot signatures, unless its other signatures are at most k. Such sets are
  joined again by the finest ranges, one for each element, of which a set needs the
  rarest quarter. What is frequent there are groups of near copies, joined by stars:
  each set with the group's smallest; then, in groups that still hold several components,
  the sets of the smallest components with all others, until every two sets of a group
  are in one component or were compared. Each such round meets several times as many sets
  as the one before, a bounded tile of elements against another in one task, and hands on
  links between components only. No group's pairs become rows, and none is left out.
- Before sets are fetched, candidates are compared by histograms of their hashes, whose
  distance never exceeds that of the sets.
- Components are found by minimum labels with pointer jumping over written tables.

Sets are known by a 64-bit hash of their elements (chance of a wrong merge among n
different sets about n*n/2**65).

Defined results: texts without words, and null texts, have an empty set and are
linked with nothing, each its own component; repeated rows and copies share a
component; a null id never names a component unless all its ids are null; rows with
equal ids but different texts are linked only through their texts; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casework.llm.arrays import U, mix, shingle_set, slices
from casework.llm.shared import small_batches
from casework.session import cut_lineage

COLD = 16
LEADERS = 128  # sets of an open group that meet all others in the first round; GROWTH times as many in the next
GROWTH = 4
TILE = 1 << 18  # elements of a side that meet in one task, unless one set has more
SENT = 50_000  # set keys that a task remembers having sent
PACK = 250_000  # signatures that a task gathers before it sends them
NO_ID = -(1 << 63)


@lru_cache(maxsize=None)
def bands(percent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """(first, last) sizes of consecutive bands, the last one above *upto*."""
    out, first = [], 1
    while not out or out[-1][1] < upto:
        out.append((first, first * 100 // percent))
        first = out[-1][1] + 1
    return tuple(out)


def band_of(size: int, percent: int) -> int:
    for i, (first, last) in enumerate(bands(percent, 1 << max(8, size.bit_length() + 1))):
        if first <= size <= last:
            return i
    raise ValueError(size)


def differences(sizes: int, percent: int) -> int:
    """Most elements in which two linked sets of together *sizes* elements differ."""
    return (100 - percent) * sizes // (100 + percent)


@lru_cache(maxsize=None)
def instance(band: int, percent: int) -> tuple[int, int, tuple[tuple[int, ...], ...] | None]:
    """(k, ranges, subsets to leave out) for sets of this band and the one below it."""
    spans = bands(percent, 1 << 8)
    while len(spans) <= band:
        spans = bands(percent, spans[-1][1] * 4)
    k = differences(2 * spans[band][1], percent)
    if k <= 3:
        ranges = k + 5 if k else 1
        return k, ranges, tuple(combinations(range(ranges), k))
    return k, max(k + 1, spans[max(band - 1, 0)][0]), None


def set_key(hashes: np.ndarray) -> int:
    total = np.concatenate((mix(hashes + U(0x632BE59BD9B4E019)), [U(len(hashes))])).sum(dtype=U, keepdims=True)
    return int(mix(total.reshape(1)).view(np.int64)[0])


def signatures(hashes: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """For both instances of the set: (instance, slack, signatures).

    Slack is the number of signatures a set may leave out, plus one: a linked pair agrees on
    all but k ranges, so of more than k signatures it shares one.
    """
    out = []
    own = band_of(len(hashes), percent)
    values = mix(hashes ^ U(0x2545F4914F6CDD1D))
    for band in (own, own + 1):
        k, ranges, left_out = instance(band, percent)
        if k == 0:  # only equal sets, which are one set here
            out.append((band, 0, np.zeros(0, U)))
            continue
        place = ((hashes >> U(32)) * U(ranges)) >> U(32)
        name = U((band + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        if left_out is not None:
            parts = np.zeros(ranges, U)
            np.add.at(parts, place.astype(np.int64), values)
            rest = parts.sum(dtype=U) - parts[np.array(left_out)].sum(axis=1, dtype=U)
            out.append((band, 0, mix(mix(rest + name) + np.arange(len(left_out)).astype(U))))
            continue
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        inside = mix(mix(np.add.reduceat(values, starts) + name) + place[starts])
        slack = len(starts) - k
        if slack <= 0:  # too few: agreeing on empty ranges counts as well
            empty = np.setdiff1d(np.arange(ranges).astype(U), place[starts])
            inside = np.concatenate((inside, mix(mix(np.zeros(len(empty), U) + name) + empty)))
        out.append((band, slack, inside))
    return out


def sketch(hashes: np.ndarray) -> bytes:
    """Counts of the elements over a power of two of ranges, at most half as many as elements."""
    bits = max(len(hashes) // 2, 1).bit_length() - 1
    if bits == 0:
        return bytes([min(len(hashes), 255)])
    cells = np.bincount((hashes >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.abs(x.reshape(len(y), -1).sum(axis=1) - y).sum())


def _documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    return docs.select(key.alias("id"), F.col(text_column).cast("string").alias("text"))


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def set_table(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, n, k, slack0, slack1, sketch) of every row; slack by the parity of the instance."""
    names = ["id", "n", "k", "slack0", "slack1", "sketch"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole.column(1)):
                batch = whole.slice(begin, end - begin)
                rows = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    hashes = shingle_set(text.as_py(), size)
                    if not len(hashes):
                        rows.append((i, 0, None, 0, 0, None))
                        continue
                    slack = {band & 1: s for band, s, _ in signatures(hashes, percent)}
                    rows.append((i, len(hashes), set_key(hashes), slack[0], slack[1], sketch(hashes)))
                yield _columns(rows, kinds, names)

    return texts.mapInArrow(run, "id long, n long, k long, slack0 int, slack1 int, sketch binary")


def packed_signatures(texts: DataFrame, size: int, percent: int, bits: int) -> DataFrame:
    """(bucket, signatures, keys): the next 32 bits of each signature of a bucket and the keys of the sets that have them.

    The set owns a signature, not the id: ids can be null or repeated. Both are stored byte by byte,
    all first bytes together. The lowest bit of a signature is the parity of its instance.
    """

    def packs(signs: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        sign, owner = np.concatenate(signs), np.concatenate(keys)
        order = np.argsort(sign, kind="stable")
        sign, owner = sign[order], owner[order]
        bucket = (sign >> U(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = ((sign[a:b] << U(bits)) >> U(32)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
            part |= (sign[a:b] & U(1)).astype(np.uint32)
            planes = part.view(np.uint8).reshape(-1, 4).T.tobytes()
            rows.append((int(bucket[a]), planes, owner[a:b].copy().view(np.uint8).reshape(-1, 8).T.tobytes()))
        return _columns(rows, [pa.int32(), pa.binary(), pa.binary()], ["bucket", "signs", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: OrderedDict[int, None] = OrderedDict()
        signs, keys, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                hashes = shingle_set(text.as_py(), size)
                if not len(hashes):
                    continue
                key = set_key(hashes)
                if key in sent:
                    sent.move_to_end(key)
                    continue
                sent[key] = None
                if len(sent) > SENT:
                    sent.popitem(last=False)
                for band, _, found in signatures(hashes, percent):
                    signs.append((found & ~U(1)) | U(band & 1))
                    keys.append(np.full(len(found), key, np.int64))
                    held += len(found)
                if held > PACK:
                    yield packs(signs, keys)
                    signs, keys, held = [], [], 0
        if held:
            yield packs(signs, keys)

    return texts.select("text").mapInArrow(run, "bucket int, signs binary, keys binary")


def shared_signatures(packed: DataFrame, partitions: int) -> DataFrame:
    """(a, b, hot): pairs a < b of set keys that share a signature of at most COLD sets (hot is null),
    and for the more frequent ones a row (signature, set key, parity)."""

    def close(bucket: int, signs: list[bytes], keys: list[bytes]) -> Iterator[pa.RecordBatch]:
        sign = np.concatenate([np.frombuffer(s, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel() for s in signs])
        owner = np.concatenate([np.frombuffer(s, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for s in keys])
        ordered = np.sort(sign)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        keep = np.isin(sign, again)
        sign, owner = sign[keep], owner[keep]
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (owner[1:] != owner[:-1])
        sign, owner = sign[fresh], owner[fresh]
        _, run_of, count = np.unique(sign, return_inverse=True, return_counts=True)
        of_run = count[run_of] if len(sign) else np.zeros(0, np.int64)
        cold = of_run <= COLD
        left, right = [], []
        for step in range(1, COLD):
            at = np.flatnonzero(cold[: len(sign) - step] & (run_of[step:] == run_of[: len(sign) - step])) if len(sign) > step else []
            if not len(at):
                break
            left.append(owner[at])
            right.append(owner[at + step])
        if left:
            pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), axis=1), axis=0)
            none = pa.nulls(len(pairs), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], names=["a", "b", "hot"])
        hot = np.flatnonzero(~cold)
        if len(hot):
            name = (np.int64(bucket) << np.int64(32)) | sign[hot].astype(np.int64)
            parity = (sign[hot] & np.uint32(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(owner[hot]), pa.array(parity)], names=["a", "b", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, signs, keys = None, [], []
        for batch in batches:
            for bucket, s, k in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and signs:
                    yield from close(now, signs, keys)
                    signs, keys = [], []
                now = bucket
                signs.append(s)
                keys.append(k)
        if signs:
            yield from close(now, signs, keys)

    dealt = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "a long, b long, hot int")


def likely_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of set keys that sizes and sketches do not rule out."""
    side = lambda c: classes.select(F.col("k").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [
                sketch_distance(x.as_py(), y.as_py()) <= differences(p + q, percent)
                for p, q, x, y in zip(na, nb, batch.column(4), batch.column(5))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    fitting = F.greatest("na", "nb") * percent <= F.least("na", "nb") * 100
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(fitting)
    return cut_lineage(sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long"), "jaccard-likely")


def fetch_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(k, elements) of the wanted set keys, from the texts of the smallest ids that have the sets.

    Other rows may have the same id, so a text meets the ids once, however many sets an id has, and
    its set the keys. Rows without an id do not meet by id.
    """
    wanted = cut_lineage(wanted.distinct().join(classes.select("k", "id"), "k"), "jaccard-wanted")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                hashes = shingle_set(text.as_py(), size)
                if len(hashes):
                    rows.append((set_key(hashes), hashes.tobytes()))
            yield _columns(rows, [pa.int64(), pa.binary()], ["k", "elements"])

    named = F.col("id") != NO_ID
    asked = texts.join(wanted.where(named).select("id").distinct(), "id", "left_semi").select("text")
    if not wanted.where(~named).isEmpty():
        asked = asked.union(texts.where(~named).select("text"))
    found = asked.mapInArrow(elements, "k long, elements binary").join(wanted.select("k"), "k", "left_semi")
    return cut_lineage(found.dropDuplicates(["k"]), "jaccard-sets")


def linked_pairs(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact sets reach the similarity."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.toDF("a", "ea"), sets.toDF("b", "eb")
    joined = likely.join(left, "a").join(right, "b").select("a", "b", "ea", "eb")
    return cut_lineage(joined.mapInArrow(linked, "a long, b long"), "jaccard-links")


def finest(sets: DataFrame, percent: int) -> DataFrame:
    """(sign, k, n, sets): the signatures of the finest ranges, one for each element, that the sets need.

    A set shares all but a part of its elements with any set it links to, so of one more than that
    part it shares one; both sides take the elements that the fewest of these sets have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, elements in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(elements.as_py(), np.int64)
                need = len(found) - -(-percent * len(found) // 100) + 1
                columns = [found, *(np.full(len(found), v, np.int64) for v in (k, len(found), need))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sign", "k", "n", "need"])

    rows = cut_lineage(sets.mapInArrow(run, "sign long, k long, n long, need long"), "jaccard-elements")
    counts = cut_lineage(rows.groupBy("sign").agg(F.count(F.lit(1)).alias("sets")), "jaccard-element-counts")
    rank = F.row_number().over(Window.partitionBy("k").orderBy("sets", "sign"))
    chosen = rows.join(counts, "sign").withColumn("rank", rank).where("rank <= need AND sets > 1")
    return cut_lineage(chosen.select("sign", "k", "n", "sets"), "jaccard-finest")


def components(links: DataFrame) -> DataFrame:
    """(k, label): the smallest key that each linked key can reach."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both, "component-links")
    labels = cut_lineage(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "component-labels")
    while True:
        heard = both.join(labels.select(F.col("k").alias("b"), "label"), "b").groupBy(F.col("a").alias("k")).agg(F.min("label").alias("heard"))
        heard = cut_lineage(heard, "component-heard")
        lower = labels.join(heard, "k").select("k", F.least("label", "heard").alias("new"), F.col("label").alias("old"))
        # the label's own label: paths halve
        jump = labels.select(F.col("k").alias("new"), F.col("label").alias("jumped"))
        lower = cut_lineage(lower.join(jump, "new").select("k", F.least("new", "jumped").alias("label"), "old"), "component-lower")
        labels = lower.select("k", "label")
        if lower.where("label <> old").isEmpty():
            return labels


def _pairs_within(rows: DataFrame) -> DataFrame:
    """All pairs of different labels in groups of at most COLD rows."""
    other = rows.select("sign", F.col("k").alias("b"), F.col("label").alias("other"))
    return rows.select("sign", "k", "label").join(other, "sign").where("k < b AND label <> other").select(F.col("k").alias("a"), "b").distinct()


def linked_sets(docs: DataFrame, id_column: str, text_column: str, size: int, percent: int) -> DataFrame:
    """(id, n, k, label) of every row: set size, set key and the key of its component.

    A null id is NO_ID here; k and label are null for empty sets.
    """
    with small_batches(docs.sparkSession):
        return _linked_sets(docs, id_column, text_column, size, percent)


def _linked_sets(docs: DataFrame, id_column: str, text_column: str, size: int, percent: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, math.ceil(math.log2(4 * partitions)))
    texts = _documents(docs, id_column, text_column)
    table = cut_lineage(set_table(texts, size, percent), "jaccard-table")
    full = table.where("k IS NOT NULL")
    named = F.min(F.when(F.col("id") != NO_ID, F.col("id")))
    classes = full.groupBy("k").agg(
        F.coalesce(named, F.lit(NO_ID)).alias("id"), *[F.min(c).alias(c) for c in ("n", "slack0", "slack1", "sketch")]
    )
    classes = cut_lineage(classes, "jaccard-classes")
    shared = cut_lineage(shared_signatures(packed_signatures(texts, size, percent, bits), partitions), "jaccard-shared")
    pairs = shared.where("hot IS NULL").select("a", "b").distinct()
    # frequent signatures, without those that enough rarer ones make needless
    many = shared.where("hot IS NOT NULL").select(F.col("b").alias("k"), F.col("hot").alias("parity"))
    own = many.groupBy("k", "parity").agg(F.count(F.lit(1)).alias("many"))
    slack = F.when(F.col("parity") == 0, F.col("slack0")).otherwise(F.col("slack1"))
    needed = cut_lineage(own.join(classes, "k").where(F.col("many") >= slack).select("k").distinct(), "jaccard-needed")
    likely = likely_pairs(cut_lineage(pairs, "jaccard-pairs"), classes, percent)
    wanted = needed.union(likely.select(F.col("a").alias("k"))).union(likely.select(F.col("b").alias("k")))
    sets = fetch_sets(wanted, classes, texts, size)
    group = finest(sets.join(needed, "k", "left_semi"), percent).withColumn("label", F.col("k"))
    fresh = _stars(group.where(f"sets > {COLD}")).union(_pairs_within(group.where(f"sets <= {COLD}")))
    likely = likely.union(likely_pairs(cut_lineage(fresh.distinct(), "jaccard-pairs"), classes, percent)).distinct()
    links = linked_pairs(likely, sets, percent)
    labels = cut_lineage(components(links), "jaccard-labels")
    group = group.where(f"sets > {COLD}").select("sign", "k", "n")
    leaders = cut_lineage(group.groupBy("sign").agg(F.min("k").alias("k")), "jaccard-leaders")
    most = LEADERS
    while True:
        # the leaders have met all others of their group; groups of one component are done
        group = group.join(leaders, ["sign", "k"], "left_anti").join(labels, "k", "left")
        group = cut_lineage(group.withColumn("label", F.coalesce("label", "k")), "jaccard-group")
        state = group.groupBy("sign").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
        state = cut_lineage(state.where("low <> high").select("sign", "size"), "jaccard-open")
        group = cut_lineage(group.join(state, "sign"), "jaccard-open-group")
        if group.isEmpty():
            break
        leaders = _leaders(group, most)
        most *= GROWTH
        met = _meet(group, leaders, sets, percent)
        group, leaders = group.select("sign", "k", "n"), leaders.select("sign", "k")
        if not met.isEmpty():
            labels = _relabelled(labels, cut_lineage(components(met), "jaccard-merged"))
    named = table.join(labels, "k", "left").select("id", "n", "k", F.coalesce("label", "k").alias("label"))
    return cut_lineage(named, "jaccard-named")


def similar_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 5,
    percent: int = 75,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document, the smallest id it can reach by links."""
    named = linked_sets(docs, id_column, text_column, size, percent)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id"))
    smallest = named.where("label IS NOT NULL").groupBy("label").agg(F.min(doc_id).alias("first"))
    out = named.join(cut_lineage(smallest, "jaccard-first"), "label", "left")
    component = F.when(F.col("label").isNull(), doc_id).otherwise(F.col("first"))
    return out.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_similar(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = 5,
    percent: int = 75,
) -> DataFrame:
    """The rows of *docs* without all but one document of each component.

    The document with the smallest id stays (a null id counts as the largest, then the smallest
    set key). Rows of equal id and equal set are one document and stay or go together; rows without
    an id are documents of their own, of which one stays, the first by the digest of the row.
    """
    named = linked_sets(docs, id_column, text_column, size, percent).where("label IS NOT NULL")
    rank = F.struct((F.col("id") == NO_ID).alias("unnamed"), "id", "k")
    best = cut_lineage(named.groupBy("label").agg(F.min(rank).alias("best")), "jaccard-best")
    gone = named.join(best, "label").where(rank != F.col("best")).select("id", "k").distinct()
    gone = cut_lineage(gone.select(F.col("id").alias("_id"), F.col("k").alias("_k")), "jaccard-gone")
    unnamed = best.where("best.unnamed").select("best.k").join(named.where(F.col("id") == NO_ID).select("k"), "k")
    tied = unnamed.groupBy(F.col("k").alias("_k")).agg(F.count(F.lit(1)).alias("_tied")).where("_tied > 1")
    tied = cut_lineage(tied.withColumn("_id", F.lit(NO_ID)), "jaccard-tied")
    # only rows whose id is gone or tied for some text need their set looked at
    doubtful = gone.select("_id").union(tied.select("_id")).distinct().withColumn("_doubt", F.lit(True))
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    keyed = docs.withColumn("_id", key).join(doubtful, "_id", "left")
    place = keyed.columns.index(text_column)
    doubt = keyed.columns.index("_doubt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for asked, text in zip(batch.column(doubt), batch.column(place)):
                hashes = shingle_set(text.as_py(), size) if asked.as_py() else ()
                keys.append(set_key(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "_k"])

    schema = T.StructType([*keyed.schema.fields, T.StructField("_k", T.LongType())])
    looked = keyed.where("_doubt").mapInArrow(run, schema).join(gone, ["_id", "_k"], "left_anti")
    looked = looked.join(tied, ["_id", "_k"], "left")
    row = F.struct(*docs.columns)
    ones = looked.where("_tied IS NOT NULL").groupBy("_k").agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("_one"))
    kept = keyed.where("_doubt IS NULL").select(*docs.columns)
    return kept.unionByName(looked.where("_tied IS NULL").select(*docs.columns)).unionByName(ones.select("_one.*"))


def _leaders(group: DataFrame, most: int) -> DataFrame:
    """(sign, k, label, n): up to *most* sets of each group, those of its smallest components first.

    Once all sets outside a group's largest component have met the others, the group is done.
    """
    parts = cut_lineage(group.groupBy("sign", "label").agg(F.count(F.lit(1)).alias("part")), "jaccard-parts")
    sized = group.join(parts, ["sign", "label"])
    # the first of each of many shares, then the first of those, so that no group is sorted whole
    for keys in (["sign", F.pmod("k", F.lit(64))], ["sign"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("part", "label", "k"))
        sized = sized.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
    return cut_lineage(sized.select("sign", "k", "label", "n"), "jaccard-leaders")


def _meet(group: DataFrame, leaders: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): labels of different components that a leader and a set of its group link.

    Sets of near copies are in many groups together, so a set travels once, with the largest of its
    groups, and meets there the leaders of all of them. The sets of such a home are dealt into pieces
    and the leaders that come to a piece into blocks of about TILE elements; each block meets its
    piece in one task.
    """

    def unpack(side: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        found = [np.frombuffer(e.as_py(), U) for e in side.column("elements")]
        return side.column("label").to_numpy(), np.array([len(f) for f in found], np.int64), found

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        links: set[tuple[int, int]] = set()
        if len(left) and len(right):
            label, size, elements = unpack(right)
            values, place = np.unique(np.concatenate(elements), return_inverse=True)
            owner = np.repeat(np.arange(len(size)), size)
            for own, n, found in zip(*unpack(left)):
                at = np.minimum(np.searchsorted(values, found), len(values) - 1)
                has = np.zeros(len(values), bool)
                has[at[values[at] == found]] = True
                both = np.bincount(owner[has[place]], minlength=len(size))
                linked = (100 * both >= percent * (n + size - both)) & (label != own)
                links.update((min(own, x), max(own, x)) for x in np.unique(label[linked]))
        rows = np.array(sorted(links), np.int64).reshape(-1, 2)
        return pa.table({"a": rows[:, 0], "b": rows[:, 1]})

    tile = ["home", "piece", "block"]
    home = F.min(F.struct(-F.col("size"), "sign"))["sign"].alias("home")
    members = cut_lineage(group.groupBy("k", "label", "n").agg(home), "jaccard-homes")
    tiles = lambda rows, *keys: rows.groupBy(*keys).agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
    # different bits of the key for pieces and blocks
    members = members.join(tiles(members, "home"), "home").withColumn("piece", F.pmod("k", "tiles").cast("int")).drop("tiles")
    members = cut_lineage(members, "jaccard-members")
    calls = group.select("sign", "k").join(members.select("k", "home", "piece"), "k").select("sign", "home", "piece").distinct()
    called = calls.join(leaders, "sign").select("home", "piece", "k", "label", "n").distinct()
    called = cut_lineage(called, "jaccard-called")
    blocks = cut_lineage(tiles(called, "home", "piece"), "jaccard-blocks")
    dealt = called.join(blocks, ["home", "piece"]).withColumn("block", F.pmod(F.shiftright("k", 24), "tiles").cast("int"))
    members = members.join(blocks, ["home", "piece"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    left, right = (side.join(sets, "k").select(*tile, "label", "elements").toDF(*tile, "label", "elements") for side in (members, dealt))
    met = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, "a long, b long")
    return cut_lineage(met.distinct(), "jaccard-met")


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """The (k, label) of all linked keys after components, named by their labels, have merged.

    Sets without links so far are their own component; only *merged* has them.
    """
    kept = labels.join(merged.select(F.col("k").alias("label"), F.col("label").alias("new")), "label", "left")
    kept = kept.select("k", F.coalesce("new", "label").alias("label"))
    return cut_lineage(kept.union(merged.join(labels.select("k"), "k", "left_anti").select("k", "label")), "jaccard-labels")


def _stars(group: DataFrame) -> DataFrame:
    """The smallest key of each group with every key of another component."""
    lead = cut_lineage(group.groupBy("sign").agg(F.min(F.struct("k", "label")).alias("lead")), "jaccard-lead")
    met = group.join(lead, "sign").where("lead.label <> label")
    return met.select(F.col("lead.k").alias("a"), F.col("k").alias("b")).distinct()
