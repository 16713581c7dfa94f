"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and
character n-grams; a softmax over that average gives the label. The vectors are
trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents (``sample_rows``, chosen by a hash of the id, and of those as many in that
order as have ``sample_features`` hashed counts together), in one task; only the model
reaches the driver. Scoring covers every row: the softmax of an average is linear
in the vectors, so one weight per bucket is sent to the tasks, and no text is shuffled.

Defined results: an empty or null text has no features and gets the score of
the bias alone; rows whose label is null do not train; without any labelled row,
or with one class only, the score is the share of label 1 (0.5 without rows);
repeated rows get equal scores, and of all rows with one id and label one trains; a row with a null id is never held out; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.arrays import U, powers, prefix_hash, range_hash, slices, window_hashes, word_bounds
from casework.session import cut_lineage

#: Production parameters. sample_rows and sample_features bound the labelled rows that train.
BITS, DIM, EPOCHS, RATE = 17, 8, 5, 4.0
SAMPLE_ROWS, SAMPLE_FEATURES = 2500, 40_000_000
CHAR_NGRAMS = (2, 3, 4)
THRESHOLD = 0.3


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Bucket of every word, word pair and character n-gram of the whole text.

    All pairs of equal words share one feature, so that stuttering is learned whatever the word.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.int64)
    h = prefix_hash(data)
    words = range_hash(h, starts, ends)
    pairs = window_hashes(words, 2)
    pairs[words[1:] == words[:-1]] = U(1)
    keys = [words, pairs]
    inverse = powers(len(h))[1]
    for n in CHAR_NGRAMS:
        if len(data) >= n:
            keys.append(((h[n:] - h[:-n]) * inverse[: len(data) - n + 1]) * U(2 * n + 1))
    all_keys = np.concatenate(keys)
    return ((all_keys * U(0xD6E8FEB86659FD93)) >> U(64 - bits)).astype(np.int64)


@dataclass
class QualityModel:
    """Weight of label 1 against label 0 by bucket, and the bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, text: str | None) -> float:
        index = features(text, self.bits)
        z = self.bias + (float(self.weights[index].mean(dtype=np.float64)) if len(index) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, seed: int = 7) -> QualityModel:
    """Embeddings and softmax by gradient descent over (buckets, counts, label)."""
    rng = np.random.default_rng(seed)
    labels = np.array([e[2] for e in examples], np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        z = 60.0 * (2 * share - 1)
        return QualityModel(np.zeros(1 << bits, np.float32), z, bits)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << bits, DIM)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    steps, done = EPOCHS * len(examples), 0
    # each class weighs the same, so that the rare one is learned
    balance = 0.5 / np.array([1 - share, share], np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            index, count, label = examples[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            if not len(index):
                continue
            part = count / count.sum()
            mean = part @ vectors[index]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            p *= balance[label]
            back = out @ p
            out -= np.float32(0.1) * rate * np.outer(mean, p)
            bias -= np.float32(0.01) * rate * p
            # the average spreads the step over the features; the norm of the shares gives it back
            scale = part / max(float(np.sqrt(part @ part)), 1e-6)
            vectors[index] -= rate * np.outer(scale, back).astype(np.float32) * np.float32(0.5)
    gap = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
    return QualityModel(gap, float(bias[1] - bias[0]), bits)


def held_out(id_column: Column) -> Column:
    """Every fifth document by the checksum of its id; a null id is not."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    sample_features: int = SAMPLE_FEATURES,
) -> DataFrame:
    """(id, label, buckets, counts, place) of at most *sample_rows* labelled documents outside the held-out fold."""
    key = F.col(id_column)
    sample = (
        labels.select(key.alias("id"), F.col(label_column).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .distinct()
        .orderBy(F.xxhash64("id", F.lit(11)), "id", "label")
        .limit(sample_rows)
    )
    # bounded by sample_rows, so it may travel to every task
    picked = docs.select(key.alias("id"), F.col(text_column).cast("string").alias("text"))
    labelled = picked.join(F.broadcast(sample), "id").groupBy("id", "label")
    rows = labelled.agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in slices(whole.column(2)):
                batch = whole.slice(begin, end - begin)
                index, counts = [], []
                for text in batch.column(2):
                    i, c = np.unique(features(text.as_py()), return_counts=True)
                    index.append(i.astype(np.int32))
                    counts.append(c.astype(np.float32))
                arrays = [
                    batch.column(0),
                    batch.column(1),
                    pa.array(index, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.float32())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "buckets", "counts"])

    place = F.xxhash64("id", F.lit(11))
    counted = rows.mapInArrow(count, "id long, label int, buckets array<int>, counts array<float>")
    counted = cut_lineage(counted.withColumn("place", place), "quality-sample")
    sizes = counted.select("place", F.size("buckets").alias("n")).toArrow().sort_by("place")
    fits = np.cumsum(sizes["n"].to_numpy().astype(np.int64)) <= sample_features
    if not fits.all():
        counted = counted.where(F.col("place") < int(sizes["place"][int(fits.sum())].as_py()))
    return counted


def fit_quality(docs: DataFrame, labels: DataFrame, **options) -> QualityModel:
    """Learns from the ``training_rows`` (which takes the *options*), in one task that holds them all."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for i, label, buckets, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                examples.append((buckets.values.to_numpy(), counts.values.to_numpy(), label, i))
        # the order of arrival is not fixed; the order of training is
        examples.sort(key=lambda e: (e[3], e[2], len(e[0]), e[0].tobytes()))
        model = train([e[:3] for e in examples])
        arrays = [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.bits])]
        yield pa.RecordBatch.from_arrays(arrays, names=["weights", "bias", "bits"])

    rows = training_rows(docs, labels, **options).select(F.col("id").cast("long"), "label", "buckets", "counts")
    if rows.isEmpty():
        return train([])
    found = rows.coalesce(1).mapInArrow(learn, "weights binary, bias double, bits long").first()
    return QualityModel(np.frombuffer(bytes(found.weights), np.float32), found.bias, found.bits)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(
    docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, held_out, score and prediction of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(2)]
            predicted = [int(s >= THRESHOLD) for s in scores]
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    key = F.col(id_column)
    picked = docs.select(key.cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """The rows, unchanged, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) >= THRESHOLD for t in texts], pa.bool_())

    # only the text goes through Python, and only the verdict comes back
    return docs.where(good(F.col(text_column).cast("string")))
