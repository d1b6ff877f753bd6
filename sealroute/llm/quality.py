"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its hashed words, word pairs and character n-grams; a softmax over
two classes reads that mean. Vectors and softmax are trained by stochastic gradient descent in numpy, in one task, on
a sample of labelled rows with a bound. As the mean and the softmax's input are linear, a text is scored by one number
a bucket, and a long text piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.llm import features as X
from sealroute.llm.common import add_columns, attach, held_out

BUCKETS = 1 << 16
SIZES = (3, 4)
#: Labelled documents that training uses at most, smallest hash of the id first.
TRAIN_ROWS = 3000
THRESHOLD = 0.7


@dataclass(frozen=True)
class QualityModel:
    """Vectors of the buckets, softmax weights and their bias."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def slopes(self) -> tuple[np.ndarray, float]:
        """What a bucket adds to the log-odds of the better class, and the rest of these."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def buckets_of(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of a text's features with repeats, a piece at a time."""
    for piece in X.pieces(text):
        points = X.code_points(piece)
        values = X.word_values(points)
        yield np.concatenate([X.word_buckets(values, BUCKETS), X.pair_buckets(values, BUCKETS),
                              *(X.ngrams(points, size, BUCKETS) for size in SIZES)])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, shares = [], []
        for text in batch.column("text").to_pylist():
            counts = sum((np.bincount(found, minlength=BUCKETS) for found in buckets_of(text)), np.zeros(BUCKETS, np.int64))
            place = np.flatnonzero(counts)
            places.append(place.astype(np.int32))
            shares.append((counts[place] / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("label"), pa.array(places, pa.list_(pa.int32())),
             pa.array(shares, pa.list_(pa.float32()))], ["rank", "label", "places", "shares"])


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int = 16, epochs: int = 12, rate: float = 0.5,
            seed: int = 1) -> QualityModel:
    """Train on (buckets, their shares, class) rows by stochastic gradient descent, one document a step."""
    source = np.random.default_rng(seed)
    vectors = source.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    weights, bias = np.zeros((size, 2), np.float32), np.zeros(2, np.float32)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for at in source.permutation(len(rows)):
            place, share, label = rows[at]
            step = np.float32(rate * (1 - steps / total))
            steps += 1
            mean = share @ vectors[place]
            logits = mean @ weights + bias
            odds = np.exp(logits - logits.max())
            error = (odds / odds.sum()).astype(np.float32)
            error[label] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * error
            # A bucket's share is small, so its vector would hardly move: the step is scaled by the number of buckets.
            vectors[place] -= (step * min(len(place), 200)) * np.outer(share, back)
    return QualityModel(vectors, weights, bias)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column("rank").to_pylist(), batch.column("label").to_pylist(),
                    (np.array(one, np.int32) for one in batch.column("places").to_pylist()),
                    (np.array(one, np.float32) for one in batch.column("shares").to_pylist()))
    rows.sort(key=lambda row: (row[0], row[1], len(row[2])))
    model = descend([(place, share, label) for _, label, place, share in rows])
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.vectors.astype(np.float32).tobytes()]), pa.array([model.weights.tobytes()]),
         pa.array([model.bias.tobytes()]), pa.array([len(rows)], pa.int64())], ["vectors", "weights", "bias", "used"])


def sampled(labelled: DataFrame, docs: DataFrame, label: str, rows: int) -> DataFrame:
    """(rank, label, text) of at most ``rows`` labelled texts of the training part, by the hash of their id.

    An id's different texts count each, so repeated ids do not widen the sample.
    """
    ids = labelled.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.xxhash64("doc_id").alias("rank"), F.col(label).cast("int").alias("label")).distinct().orderBy(
        "rank", "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    narrow = texts.drop("text").join(F.broadcast(ids), "doc_id").distinct()
    chosen = narrow.orderBy("rank", "doc_id", "label", "print").limit(rows)
    return texts.join(F.broadcast(chosen), ["doc_id", "print"]).dropDuplicates(["doc_id", "label", "print"]).select(
        "rank", "label", "text")


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from the labelled documents outside the held-out part; labels are 0 or 1, others are left out.

    Without any labelled document every text scores one half.
    """
    attach(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1))
    rows = sampled(known, docs, label, rows).mapInArrow(
        _featurise, "rank bigint, label int, places array<int>, shares array<float>").repartition(1).mapInArrow(
        _train, "vectors binary, weights binary, bias binary, used bigint").collect()
    made = next((row for row in rows if row.used), None)
    if made is None:
        return QualityModel(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2), np.float32), np.zeros(2, np.float32))
    weights = np.frombuffer(made.weights, np.float32).reshape(-1, 2)
    return QualityModel(np.frombuffer(made.vectors, np.float32).reshape(BUCKETS, -1), weights,
                        np.frombuffer(made.bias, np.float32))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score (0 to 1, higher: the better class is likelier) and predicted (1 from ``threshold`` on).

    Null and empty texts have no feature and score as the bias does. Columns of the same names are replaced.
    """
    attach(docs.sparkSession)
    slopes, rest = model.slopes()

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                total, count = 0.0, 0
                for found in buckets_of(text):
                    total += float(slopes[found].sum(dtype=np.float64))
                    count += len(found)
                out.append(1 / (1 + np.exp(-np.clip(total / max(1, count) + rest, -500, 500))))
            yield pa.array(out, pa.float64())

    scored = add_columns(docs, score=score.asNondeterministic()("text"))
    return add_columns(scored, predicted=(F.col("score") >= threshold).cast("int"))
