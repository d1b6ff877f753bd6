"""Whitening of embeddings by QDWH spectral divide and conquer.

Spark makes the fit list (each distinct vector once, written once), its exact sums and its covariance: every task
adds up its own rows as one matrix, and the matrices are summed by row number, so the driver gets d rows of d numbers
however many vectors there are. There the covariance is shifted, the polar factor of the shifted matrix (dynamically
weighted Halley iterations by QR) gives the projectors on the eigenvectors above and below the shift, and both
invariant subspaces are split again until each is one component. The components are broadcast, d by 16 numbers, and
every task whitens its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealroute.llm.common import keep, work

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: An eigenvalue below this share of the largest one is rounding, not variance; it has no component.
LEAST_SHARE = 1e-11
EPS = float(np.finfo(np.float64).eps)
_LOW = (1 << 32) - 1
OUTPUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def polar(matrix: np.ndarray, most: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH, its iterations by QR."""
    size = len(matrix)
    norm = np.linalg.norm(matrix)
    if norm == 0:
        return np.zeros_like(matrix)
    factor, low, one = matrix / norm, EPS, np.eye(size)
    for _ in range(most):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        a = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q = np.linalg.qr(np.vstack([np.sqrt(c) * factor, one]))[0]
        new = (b / c) * factor + ((a - b / c) / np.sqrt(c)) * (q[:size] @ q[size:].T)
        new = (new + new.T) / 2
        moved, factor = np.linalg.norm(new - factor), new
        low = min(1.0, low * (a + b * square) / (1 + c * square))
        if 1 - low < 10 * EPS and moved < 1e-12 * size:
            break
    return factor


def _shifts(matrix: np.ndarray) -> Iterator[float]:
    """Where to cut a spectrum: the middle of the diagonal, then points beside its mean."""
    diagonal = np.diag(matrix)
    mean = diagonal.mean()
    yield float(np.median(diagonal))
    yield float(mean)
    spread = np.linalg.norm(matrix - mean * np.eye(len(matrix))) / np.sqrt(len(matrix))
    for step in range(1, 40):
        for sign in (1, -1):
            yield float(mean + sign * spread * step * 0.0371)


def _split(matrix: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if no shift parts them."""
    size = len(matrix)
    start = np.random.default_rng(size).standard_normal((size, size))
    best = None
    for shift in _shifts(matrix):
        factor = polar(matrix - shift * np.eye(size))
        above = (factor + np.eye(size)) / 2
        rank = round(float(np.trace(above)))
        # Off one and minus one lies an eigenvalue at the shift itself, which belongs to neither side.
        if not 0 < rank < size or np.linalg.norm(factor @ factor - np.eye(size)) > 1e-8:
            continue
        basis = np.linalg.qr(above @ start[:, :rank])[0]
        full = np.linalg.qr(above @ basis, mode="complete")[0]
        high, low = full[:, :rank], full[:, rank:]
        left = np.linalg.norm(low.T @ matrix @ high)
        if best is None or left < best[0]:
            best = (left, high, low)
        if left <= tolerance:
            break
    return best and best[1:]


def spectral_parts(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by recursive spectral division."""
    size = len(matrix)
    tolerance = 4 * EPS * np.sqrt(max(size, 1)) * np.linalg.norm(matrix)
    pending, parts = [(matrix, np.eye(size))], []
    while pending:
        block, basis = pending.pop()
        count = len(block)
        middle = np.diag(block).mean() if count else 0.0
        if count <= 1 or np.linalg.norm(block - middle * np.eye(count)) <= tolerance:
            parts.append((np.diag(block), basis))
            continue
        halves = _split(block, tolerance)
        if halves is None:
            parts.append((np.diag(block), basis))
            continue
        for half in halves:
            inner = half.T @ block @ half
            pending.append(((inner + inner.T) / 2, basis @ half))
    values = np.concatenate([part[0] for part in parts]) if parts else np.zeros(0)
    vectors = np.hstack([part[1] for part in parts]) if parts else np.zeros((0, 0))
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums ``mean`` * n + ``rest``; ``rows`` turns a centred vector into its components."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    rows: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def centred(self, values: np.ndarray) -> np.ndarray:
        return (values - self.mean) - self.rest / self.n

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; null where a long cannot hold one."""
        moved = values - self.mean
        largest = float(np.abs(moved).max(initial=0)) * self.n + self.n
        if largest * largest * max(values.shape[1], 1) < 2.0**62:
            parts = moved * self.n - self.rest
            return (parts * parts).sum(axis=1).tolist()
        sums = [sum((int(x) * self.n - int(r)) ** 2 for x, r in zip(row, self.rest)) for row in moved]
        return [one if one < 1 << 63 else None for one in sums]


def fixed_point(vector: Column) -> Column:
    """Each entry as a whole number; null if the vector is null or holds a null, a non-finite entry or one whose
    whole number a long cannot hold."""
    def held(entry: Column) -> Column:
        return F.coalesce(F.abs(entry.cast("double")) * SCALE < 2.0**62, F.lit(False)) & ~F.isnan(entry.cast("double"))

    whole = F.transform(vector, lambda entry: F.floor(entry.cast("double") * SCALE) + SHIFT)
    return F.when(F.forall(vector, held), whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summed(frame: DataFrame, value: Callable[[np.ndarray], np.ndarray]) -> list[tuple[int, list[float]]]:
    """``value`` (a matrix) of each batch of ``x``, added up over all: its rows with their numbers.

    A task sends its sum once, row by row; the rows of one number meet and are added as they come.
    """
    schema = pa.schema([("i", pa.int64()), ("part", pa.list_(pa.float64()))])

    def out(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(total, pa.int64()), pa.array(total.values(), schema.field("part").type)], schema=schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = value(_matrix(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            for start in range(0, len(total), 64):
                yield out({i: total[i] for i in range(start, min(start + 64, len(total)))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)) if batch.num_rows else []):
                total[i] = total[i] + part if i in total else part
        if total:
            yield out(total)

    kind = "i bigint, part array<double>"
    rows = frame.select("x").mapInArrow(partial, kind).repartition("i").mapInArrow(add, kind).collect()
    return sorted((row.i, row.part) for row in rows)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension: halves of 32 bits, so that no partial sum overflows."""
    schema = pa.schema([("i", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch.column(0))
                n, high, low = n + len(values), high + (values >> 32).sum(axis=0), low + (values & _LOW).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high))), pa.array([n] * len(high)), pa.array(high), pa.array(low)], schema=schema)

    parts = fit.select("x").mapInArrow(partial, "i bigint, n bigint, high bigint, low bigint")
    whole = [F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in ("n", "high", "low")]
    rows = parts.groupBy("i").agg(*whole).orderBy("i").collect()
    return (int(rows[0].n) if rows else 0), [(int(row.high) << 32) + int(row.low) for row in rows]


def _common_length(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, the longer one of several."""
    lengths = vectors.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("rows"))
    found = lengths.orderBy(F.desc("rows"), F.desc("length")).first()
    return found.length if found else 0


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x`` of one length; None if it has no variance at all."""
    n, sums = _sums(fit)
    if n == 0:
        return None
    mean = np.array([one // n for one in sums], np.int64)
    base = Whitening(n, mean, np.array([one % n for one in sums], np.int64), np.zeros((len(sums), 0)), np.zeros(0))

    def products(values: np.ndarray) -> np.ndarray:
        centred = base.centred(values)
        return centred.T @ centred

    covariance = np.array([row for _, row in _summed(fit, products)]) / n
    values, vectors = spectral_parts((covariance + covariance.T) / 2)
    count = int((values[:components] > LEAST_SHARE * max(values[0], 0)).sum()) if len(values) and values[0] > 0 else 0
    if count == 0:
        return None
    rows = vectors[:, :count] / np.sqrt(values[:count])
    model = Whitening(n, mean, base.rest, rows, values[:count] / np.trace(covariance))

    def whitened_products(values: np.ndarray) -> np.ndarray:
        """Products of the components, and in a last row their sums: the covariance is centred by them."""
        whitened = model.centred(values) @ rows
        return np.vstack([whitened.T @ whitened, whitened.sum(axis=0)])

    found = np.array([row for _, row in _summed(fit, whitened_products)]) / n
    error = np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(count)).max()
    return Whitening(n, mean, base.rest, rows, model.explained, float(error))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row a vector and component.

    Vectors that are null, or hold a null, a non-finite entry or one too large for a long, are left out, and so are
    those of another length than the most frequent one (the longer of several). Every distinct vector counts once in
    the fit, every row is whitened, null and repeated keys included. Components whose eigenvalue is below
    ``LEAST_SHARE`` of the largest are rounding and left out, so equal vectors alone or an empty table give no rows.
    Equal eigenvalues have no order of their own; any orthonormal components of their space are given. Other columns
    are not looked at.
    """
    folder = work(vectors, "whitening")
    whole = vectors.select(F.col(key).alias("key"), fixed_point(F.col(vector)).alias("x")).where("x is not null")
    length = _common_length(whole)
    held = whole.where(F.size("x") == length)
    model = fit_whitening(keep(held.select("x").distinct(), folder, "fit"), components) if length else None
    kind = f"{key} {vectors.schema[key].dataType.simpleString()}, {OUTPUT}"
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], kind)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        count = fitted.rows.shape[1]
        for batch in batches:
            values = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(fitted.mean)), np.int64)
            rows = len(values)
            each = np.repeat(np.arange(rows), count)
            whitened = fitted.centred(values) @ fitted.rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(len(each), fitted.n)), pa.array(fitted.deviations(values), pa.int64()).take(pa.array(each)),
                pa.array(whitened.ravel()), pa.array(np.tile(fitted.explained, rows)),
                pa.array(np.full(len(each), fitted.identity_error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, kind)
