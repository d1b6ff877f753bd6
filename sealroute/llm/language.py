"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of distinct n-grams of 1 to ``LONGEST`` characters that
both hold, over the root of the product of their numbers of distinct n-grams. A few texts of each language are the
landmarks of a Nyström approximation; kernel ridge regression, one language against the rest, is solved on the kernel
values with the landmarks. Texts are scored in batches: presence matrix times landmark matrix, then times weights.

The score only compares the learned languages, so text of none of them has one near a half. Whether a text is like its
language at all is told by its likeness, the share of its n-grams that any landmark of the language holds. A text that
is unlike only by numbers and keys among its words is looked at again without them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sealroute.llm import features as X
from sealroute.llm.common import attach, carried, drop_clashes, held_out, keep, restored, work
from sealroute.operators.keyed import fits_broadcast

LONGEST = 3
BUCKETS = 1 << 15
#: Training texts of all languages together, and landmarks among them, at most.
TRAIN_ROWS, LANDMARKS = 1600, 96
#: A text is unlike its language below this part of the likeness that all but this share of the training texts reach.
LIKE, RARE = 0.7, 0.05
UNKNOWN = "und"
_ROWS = 256
_HASHES = 1 << 24


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the buckets that any landmark holds, landmarks by those buckets, their sizes, regression weights.

    ``held`` tells which of the buckets a language's landmarks hold, ``limits`` the least likeness of its texts.
    """

    languages: tuple[str, ...]
    columns: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    held: np.ndarray
    limits: np.ndarray

    def kernel(self, presence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Kernel values of texts (rows: which of ``columns`` they hold) with the landmarks."""
        return (presence @ self.landmarks.T) / np.sqrt(np.maximum(1, np.outer(sizes, self.sizes)))

    def likeness(self, presence: np.ndarray, sizes: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Share of each text's filled buckets that a landmark of its language (a place in ``languages``) holds."""
        return (presence * self.held[language]).sum(axis=1) / np.maximum(1, sizes)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def without_numbers(text: str) -> str:
    """The words of a text that hold no digit."""
    return " ".join(word for word in text.split() if not any(map(str.isdigit, word)))


def present(text: str | None) -> np.ndarray:
    """Which buckets the n-grams of a text fill."""
    mask = np.zeros(BUCKETS, bool)
    for piece in X.pieces(text):
        points = X.code_points(piece)
        for size in range(1, LONGEST + 1):
            mask[X.ngrams(points, size, BUCKETS)] = True
    return mask


def _limit(masks: list[np.ndarray], landmarks: int) -> float:
    """The least likeness of a language from its training texts, the first of which are its landmarks.

    A landmark is compared with the others, so a language of one text has no limit.
    """
    often = np.sum(masks[:landmarks], axis=0)
    shares = [float((often[mask] > (place < landmarks)).sum() / max(1, mask.sum())) for place, mask in enumerate(masks)]
    return LIKE * float(np.quantile(shares, RARE))


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> LanguageModel:
    """Solve the regressions on (language, filled buckets) rows, which come in the order landmarks are picked in."""
    languages = tuple(sorted({language for language, _ in rows}))
    each = max(1, landmarks // len(languages))
    texts = [[mask for name, mask in rows if name == language] for language in languages]
    dense = np.array([mask for masks in texts for mask in masks[:each]], dtype=np.float32)
    columns = np.flatnonzero(dense.any(axis=0))
    held = np.array([np.any(masks[:each], axis=0)[columns] for masks in texts])
    limits = np.array([_limit(masks, each) for masks in texts])
    empty = LanguageModel(languages, columns, dense[:, columns], dense.sum(axis=1), np.empty((0, 0)), held, limits)
    targets = np.array([[1.0 if name == language else -1.0 for language in languages] for name, _ in rows])
    kernel = np.concatenate([
        empty.kernel(np.array([mask[columns] for _, mask in rows[at : at + _ROWS]], dtype=np.float32),
                     np.array([mask.sum() for _, mask in rows[at : at + _ROWS]], dtype=np.float64))
        for at in range(0, len(rows), _ROWS)]).astype(np.float64)
    own = empty.kernel(empty.landmarks, empty.sizes).astype(np.float64)
    # Every language weighs the same, whatever its share of the sample.
    counts = Counter(name for name, _ in rows)
    share = np.array([1 / counts[name] for name, _ in rows])
    left = kernel.T @ (kernel * share[:, None]) + ridge * own + 1e-9 * np.eye(len(own))
    weights = np.linalg.solve(left, kernel.T @ (targets * share[:, None]))
    return LanguageModel(languages, columns, empty.landmarks, empty.sizes, weights, held, limits)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.packbits(present(text)).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("lang"), pa.array(packed, pa.binary())], ["rank", "lang", "packed"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)))]
    rows.sort()
    if rows:
        model = fit([(name, np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)) for _, name, packed in rows])
        parts = [model.columns.astype(np.int32), model.landmarks.astype(np.float32), model.sizes.astype(np.float64),
                 model.weights.astype(np.float64), model.held.astype(bool), model.limits.astype(np.float64)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(model.languages)], pa.list_(pa.string()))] + [pa.array([part.tobytes()]) for part in parts],
            ["languages", "columns", "landmarks", "sizes", "weights", "held", "limits"])


def train_language(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel | None:
    """Learn from texts with a language outside the held-out part: as many of each language, at most ``rows`` in all.

    Documents need a letter and are picked by the hash of their id; an id's different texts count each. None if there
    are none. Of more than ``rows`` languages only as many are learned.
    """
    attach(docs.sparkSession)
    texts = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("print")).where(
        F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    known = texts.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = keep(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("known")), work(docs, "language"), "each")
    most = max(1, rows // max(1, each.count()))
    # Beside a table that was checked to be small the ids are thinned where they are read; they meet by language after.
    each = F.broadcast(each) if fits_broadcast(each) else each
    # The smallest hashes of a language are among twice as many as are wanted, so few ids of it are ranked.
    thinned = known.select("doc_id", "lang", "print", F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES)).alias("rank")).join(
        each, "lang").where(F.col("rank") * F.col("known") <= F.lit(2 * (most + 20) * _HASHES)).drop("known")
    by_hash = Window.partitionBy("lang").orderBy("rank", "doc_id", "print")
    placed = thinned.distinct().withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= most)
    chosen = placed.orderBy("place", "rank", "doc_id").limit(rows).drop("place")
    found = texts.join(F.broadcast(chosen), ["doc_id", "lang", "print"]).dropDuplicates(["doc_id", "lang", "print"]).select(
        "rank", "lang", "text").mapInArrow(
        _pack, "rank bigint, lang string, packed binary").repartition(1).mapInArrow(
        _solve, "languages array<string>, columns binary, landmarks binary, sizes binary, weights binary, held binary, "
        "limits binary").collect()
    if not found:
        return None
    made = found[0]
    columns = np.frombuffer(made.columns, np.int32)
    return LanguageModel(
        tuple(made.languages), columns, np.frombuffer(made.landmarks, np.float32).reshape(-1, len(columns)),
        np.frombuffer(made.sizes, np.float64), np.frombuffer(made.weights, np.float64).reshape(-1, len(made.languages)),
        np.frombuffer(made.held, bool).reshape(-1, len(columns)), np.frombuffer(made.limits, np.float64))


def _predicted(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents with lang_pred: the language, its score, and whether the text is like the language at all."""
    attach(docs.sparkSession)

    @F.arrow_udf("struct<lang: string, score: double, alike: boolean>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores, alike = [], [], []
            for at in range(0, len(texts), _ROWS):
                part = texts.slice(at, _ROWS).to_pylist()
                known = [model is not None and has_letter(text) for text in part]
                presence = np.zeros((len(part), len(model.columns) if model else 0), np.float32)
                sizes = np.ones(len(part))
                for row, text in enumerate(part):
                    if known[row]:
                        mask = present(text)
                        presence[row] = mask[model.columns]
                        sizes[row] = mask.sum()
                values = model.kernel(presence, sizes) @ model.weights if model else np.zeros((len(part), 1))
                best = values.argmax(axis=1)
                names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores += [float(np.clip((value[b] + 1) / 2, 0, 1)) if k else 0.0
                           for value, b, k in zip(values, best, known)]
                if model:
                    enough = model.likeness(presence, sizes, best) >= model.limits[best]
                    for row in np.flatnonzero(known & ~enough):
                        rest = without_numbers(part[row])
                        if has_letter(rest):
                            mask = present(rest)
                            share = model.likeness(mask[model.columns][None], np.array([mask.sum()]), best[[row]])
                            enough[row] = share[0] >= model.limits[best[row]]
                    alike += (known & enough).tolist()
                else:
                    alike += [False] * len(part)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(alike, pa.bool_())],
                ["lang", "score", "alike"])

    return drop_clashes(docs, "lang_pred", "score").withColumn("lang_pred", predict.asNondeterministic()("text"))


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.col("lang_pred.score")).withColumn("lang_pred", F.col("lang_pred.lang"))


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents with lang_pred and score (0 to 1, half-way between the regression's two targets at one half).

    Null, empty and letterless texts are ``und`` with score 0, as is every text without a model. Ties go to the first
    language by name. Columns of the same names are replaced. The score compares the learned languages with each other
    and does not fall for texts of none of them; ``identified`` asks for likeness as well.
    """
    return _named(_predicted(docs, model))


def identified(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """The documents whose language the model can tell, with their own columns.

    They have a letter, a score from ``least`` on, and are like their language: ``LIKE`` times the likeness that all
    but ``RARE`` of the language's training texts reach. A language with one training text rejects nothing as unlike.
    """
    found = _predicted(carried(docs, "text"), train_language(docs)).where(
        (F.col("lang_pred.lang") != UNKNOWN) & (F.col("lang_pred.score") >= least) & F.col("lang_pred.alike"))
    return found.select(*restored(docs.columns, ("text",)))
