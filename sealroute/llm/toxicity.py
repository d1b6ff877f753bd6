"""Toxicity: a classifier chain of linear models over hashed words and character n-grams.

The categories are predicted one after the other; each model reads how often a text holds the selected features (as
the logarithm of one and the count) and the probabilities of the categories before it. For training these come from models that did not see the row (out of fold),
so later models learn from the errors that earlier ones make on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealroute.llm import features as X
from sealroute.llm.common import attach, drop_clashes
from sealroute.llm.quality import sampled

BUCKETS = 1 << 18
SIZES = (4, 5, 7)
#: Labelled documents that training uses at most (by the hash of their id), and features that models read.
TRAIN_ROWS, FEATURES = 6000, 4000
FOLDS = 5
#: Categories of severity: at least so many different words that only toxic texts hold; the label itself comes last.
SEVERITY = (("severe", 5), ("marked", 2))
LABEL = "toxic"
CATEGORIES = (*(name for name, _ in SEVERITY), LABEL)


@dataclass(frozen=True)
class ChainModel:
    """The selected buckets, and each category's weights: features, earlier categories, bias."""

    categories: tuple[str, ...]
    chosen: np.ndarray
    weights: tuple[np.ndarray, ...]

    def probabilities(self, held: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of each category, from the positions and values of the chosen features that a text holds."""
        before: list[float] = []
        for weight in self.weights:
            linear = weight[held] @ value + weight[-1]
            linear += sum(w * p for w, p in zip(weight[len(self.chosen) : -1], before))
            before.append(float(1 / (1 + np.exp(-np.clip(linear, -500, 500)))))
        return np.array(before)


def _plain(piece: str) -> str:
    """A piece with a space in place of whatever is neither letter nor digit: a word counts without its punctuation."""
    return piece.translate(_PLAIN) if piece.isascii() else "".join(c if c.isalnum() else " " for c in piece)


def _buckets(text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The buckets of the words and those of all n-grams, by piece of the text."""
    for piece in X.pieces(text):
        points = X.code_points(_plain(piece))
        yield X.word_buckets(X.word_values(points), BUCKETS), np.concatenate([X.ngrams(points, size, BUCKETS) for size in SIZES])


def held_buckets(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of a text's words, those of all its features, and the values of the latter."""
    found = list(_buckets(text))
    words = np.concatenate([np.empty(0, np.int64), *(one for one, _ in found)])
    every, counts = np.unique(np.concatenate([words, *(rest for _, rest in found)]), return_counts=True)
    return np.unique(words), every, np.log2(1 + counts).astype(np.float32)


def held_chosen(text: str | None, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The chosen features (by ``place`` of a bucket, -1 if not chosen) that a text holds, and their values."""
    counts = np.zeros(width, np.int64)
    for both in _buckets(text):
        for buckets in both:
            at = place[buckets]
            counts += np.bincount(at[at >= 0], minlength=width)
    held = np.flatnonzero(counts)
    return held, np.log2(1 + counts[held]).astype(np.float32)


_PLAIN = {code: " " for code in range(128) if not chr(code).isalnum()}


def _logistic(rows: list[np.ndarray], values: list[np.ndarray], extra: np.ndarray, target: np.ndarray, width: int, penalty: float = 1e-3,
              rounds: int = 120) -> np.ndarray:
    """Weights of a logistic regression on sparse rows and dense columns, by gradient descent with adapted steps."""
    lengths = np.array([len(row) for row in rows])
    flat, value = np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0), *values])
    owner = np.repeat(np.arange(len(rows)), lengths)
    weight = np.zeros(width + extra.shape[1] + 1)
    squares = np.full(len(weight), 1e-8)
    for _ in range(rounds):
        linear = np.bincount(owner, weight[flat] * value, len(rows)) + extra @ weight[width:-1] + weight[-1]
        error = (1 / (1 + np.exp(-np.clip(linear, -30, 30))) - target) / len(rows)
        slope = np.concatenate([np.bincount(flat, error[owner] * value, width), error @ extra, [error.sum()]])
        slope[:-1] += penalty * weight[:-1] / 10
        squares += slope**2
        weight -= 0.5 * slope / np.sqrt(squares)
    return weight


def _frequency(rows: list[np.ndarray], picked: np.ndarray) -> np.ndarray:
    """How many of the picked rows hold each bucket."""
    return np.bincount(np.concatenate([np.empty(0, np.int64), *(rows[i] for i in np.flatnonzero(picked))]), minlength=BUCKETS)


@dataclass(frozen=True)
class _View:
    """What some rows teach before any model: targets by category (of these rows), features, and all rows by them."""

    targets: list[np.ndarray]
    chosen: np.ndarray
    rows: list[np.ndarray]
    values: list[np.ndarray]


def _view(words: list[np.ndarray], held: list[np.ndarray], values: list[np.ndarray], toxic: np.ndarray, seen: np.ndarray) -> _View:
    """Severity words and features selected from the ``seen`` rows alone."""
    inside, outside = seen & toxic, seen & ~toxic
    positive, negative = max(1, inside.sum()), max(1, outside.sum())
    # Words of at least five toxic texts, fifty times as frequent there as elsewhere.
    telling = _frequency(words, inside)
    telling = (telling >= 5) & (telling / positive > 50 * _frequency(words, outside) / negative)
    known = np.array([int(telling[row].sum()) for row in words])
    targets = [np.where(toxic & (known >= least), 1.0, 0.0) for _, least in SEVERITY] + [toxic.astype(float)]

    found, other = _frequency(held, inside), _frequency(held, outside)
    both = (found + other) / (positive + negative)
    gain = np.where(found >= 3, (found / positive - other / negative) ** 2 / np.maximum(both * (1 - both), 1e-12), 0)
    order = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = np.sort(order[gain[order] > 0])
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    return _View(targets, chosen, [place[row][place[row] >= 0] for row in held],
                 [value[place[row] >= 0] for row, value in zip(held, values)])


def out_of_fold(words: list[np.ndarray], held: list[np.ndarray], values: list[np.ndarray], label: np.ndarray,
                folds: int = FOLDS) -> np.ndarray:
    """Probability of each category (columns) for each row, from models that learned nothing from that row.

    Features, severity words and weights of a fold come from the other folds; equal rows share a fold.
    """
    toxic = label == 1
    first: dict[bytes, int] = {}
    fold = np.array([first.setdefault(row.tobytes() + value.tobytes(), i) for i, (row, value) in enumerate(zip(held, values))],
                    np.int64) % folds
    views = [_view(words, held, values, toxic, fold != part) for part in range(folds)]
    earlier = np.zeros((len(held), 0))
    for category in range(len(CATEGORIES)):
        unseen = np.zeros(len(held))
        for part, view in enumerate(views):
            train, test = np.flatnonzero(fold != part), np.flatnonzero(fold == part)
            width = len(view.chosen)
            weight = _logistic([view.rows[i] for i in train], [view.values[i] for i in train], earlier[train],
                               view.targets[category][train], width)
            unseen[test] = [weight[view.rows[i]] @ view.values[i] + earlier[i] @ weight[width:-1] + weight[-1] for i in test]
        earlier = np.column_stack([earlier, 1 / (1 + np.exp(-np.clip(unseen, -500, 500)))])
    return earlier


def fit_chain(words: list[np.ndarray], held: list[np.ndarray], values: list[np.ndarray], label: np.ndarray,
              folds: int = FOLDS) -> ChainModel:
    """Select features, derive the severity categories from the label, and train the chain on all rows.

    Each category reads the out-of-fold probabilities of those before it.
    """
    earlier = out_of_fold(words, held, values, label, folds)
    view = _view(words, held, values, label == 1, np.ones(len(held), bool))
    weights = tuple(_logistic(view.rows, view.values, earlier[:, :category], target, len(view.chosen))
                    for category, target in enumerate(view.targets))
    return ChainModel(CATEGORIES, view.chosen, weights)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [held_buckets(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("label"),
             pa.array([words.astype(np.int32) for words, *_ in found], pa.list_(pa.int32())),
             pa.array([held.astype(np.int32) for _, held, _ in found], pa.list_(pa.int32())),
             pa.array([value for *_, value in found], pa.list_(pa.float32()))], ["rank", "label", "words", "held", "value"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        words, held, value = (batch.column(name) for name in ("words", "held", "value"))
        rows += [(rank, label, *(np.asarray(one[i].values) for one in (words, held, value))) for i, (rank, label) in enumerate(
            zip(batch.column("rank").to_pylist(), batch.column("label").to_pylist()))]
    rows.sort(key=lambda row: (row[0], row[1], len(row[3])))
    if rows:
        model = fit_chain(*([row[i] for row in rows] for i in (2, 3, 4)), np.array([row[1] for row in rows]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.chosen.astype(np.int64).tobytes()]),
             pa.array([[weight.tobytes() for weight in model.weights]], pa.list_(pa.binary()))], ["chosen", "weights"])


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = LABEL, rows: int = TRAIN_ROWS) -> ChainModel | None:
    """Learn from at most ``rows`` documents with a 0 or 1 label outside the held-out part; None without any."""
    attach(docs.sparkSession)
    found = sampled(labels.where(F.col(label).isin(0, 1)), docs, label, rows).mapInArrow(
        _featurise, "rank bigint, label int, words array<int>, held array<int>, value array<float>").repartition(1).mapInArrow(
        _train, "chosen binary, weights array<binary>").collect()
    if not found:
        return None
    made = found[0]
    return ChainModel(CATEGORIES, np.frombuffer(made.chosen, np.int64),
                      tuple(np.frombuffer(bytes(weight), np.float64) for weight in made.weights))


def score_toxicity(docs: DataFrame, model: ChainModel | None, threshold: float = 0.5) -> DataFrame:
    """The documents with a probability of each category (p_...), score (that of the label) and toxic.

    Null and empty texts hold no feature; without a model every probability is 0. Columns of these names are replaced.
    """
    attach(docs.sparkSession)
    place = np.full(BUCKETS, -1, np.int32)
    if model is not None:
        place[model.chosen] = np.arange(len(model.chosen))

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                out.append(np.zeros(len(CATEGORIES)) if model is None else model.probabilities(
                    *held_chosen(text, place, len(model.chosen))))
            yield pa.array(out, pa.list_(pa.float64()))

    names = [f"p_{name}" for name in CATEGORIES]
    rows = drop_clashes(docs, *names, "score", "toxic").withColumn("score", score.asNondeterministic()("text"))
    rows = rows.withColumns({name: F.col("score")[i] for i, name in enumerate(names)})
    return rows.withColumn("score", F.col(names[-1])).withColumn("toxic", F.col("score") >= threshold)
