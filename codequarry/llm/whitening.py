"""Embedding whitening by LOBPCG over a distributed table of vectors.

Points. Entries become whole numbers, floor(64 c) (the contract's offset of 1,000,000 changes no difference and is left out), equal vectors are
one point, and the points are written once, packed into blocks of rows. Sums and counts are exact.

Products. The covariance is never formed. Each turn broadcasts a block of directions Q, and every task sums (x - mean)' ((x - mean) Q) over its
blocks: a point is centred before it is multiplied, as a whole number less the mean's whole part and then less the rest. What a task returns is as
large as Q, and the tasks' sums meet in an aggregate by dimension, so the driver gets one dimension x directions table a turn.

LOBPCG. The search space of a turn is the current iterate, its residuals and the previous directions, orthonormalised; Rayleigh-Ritz on it gives the
next iterate. As the product of the whole basis is fresh, the residual ||V v - e v|| of every new iterate is computed from it and not carried along.
It ends when all residuals are below CERTIFIED of the largest eigenvalue and no longer halve; otherwise it fails after MOST_TURNS turns. GUARD directions more
than asked for stand behind the last wanted one.

Defined results: rows with a null vector, or with null or non-finite entries, have no result; of vectors of several lengths those of the most common length
(the longer one in a tie) are used, and the others have no result; entries beyond +-2**46 count as that; components whose eigenvalue is not above RANK of the largest (as for equal
vectors, or fewer points than components) don't exist; deviation is null where it exceeds 64 bits; equal vectors get equal results; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import durable, table, type_of

COMPONENTS, GUARD, SCALE, LIMIT = 16, 4, 64.0, 2.0**52
#: Bytes of a block of points, bound and floor of residuals and of eigenvalues as parts of the largest, turns.
BLOCK, CERTIFIED, RANK, MOST_TURNS = 1 << 20, 1e-11, 1e-13, 500


def _usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def whole(vector: Column) -> Column:
    """Entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))))


def valid(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows with `x`, the whole numbers of a usable vector of the most common length."""
    used = rows.where(_usable(F.col(column)))
    length = used.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return used.where(F.size(column) == (length.size if length else 0)).withColumn("x", whole(F.col(column)))


class Points:
    """Different vectors in packed blocks, with their number, dimension, sums and mean; the latter exact, split into whole part and rest."""

    def __init__(self, x: DataFrame):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i8")
                d = len(flat) // max(1, batch.num_rows)
                rows = flat.reshape(batch.num_rows, d)
                step = max(1, BLOCK // (8 * max(1, d)))
                cut = [rows[k : k + step].tobytes() for k in range(0, len(rows), step)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), pa.array([d] * len(cut), pa.int32())], ["block", "d"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low, top = 0, 0, 0, 0
            for b in _blocks(batches):
                n, high, low, top = n + len(b), high + (b >> 31).sum(axis=0), low + (b & 0x7FFFFFFF).sum(axis=0), np.maximum(top, np.abs(b).max(axis=0))
            if n:
                columns = [np.arange(len(high)), np.full(len(high), n), high, low, top]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "n", "high", "low", "top"])

        self.blocks = durable(x.select("x").distinct().mapInArrow(pack, "block binary, d int"))
        parts = self.blocks.mapInArrow(sums, "dim long, n long, high long, low long, top long")
        parts = sorted(parts.groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")), F.max("top").alias("top")).collect())
        self.n, self.d = (parts[0].n if parts else 0), len(parts)
        self.sums = [(r.high << 31) + r.low for r in parts]
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.remainder = [s % self.n for s in self.sums]
        self.rest = np.array([r / self.n for r in self.remainder])
        # no difference from the mean, times n, is larger
        self.most = self.n * (max((r.top for r in parts), default=0) + int(np.abs(self.whole).max(initial=0)) + 1)

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """V q, and the diagonal of V, for the covariance V (divisor n)."""
        d, k = q.shape
        shared = self.blocks.sparkSession.sparkContext.broadcast((q, self.whole, self.rest))
        names = [f"c{i}" for i in range(k + 1)]

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, whole, rest = shared.value
            total = np.zeros((d, k + 1))
            for b in _blocks(batches):
                y = (b - whole) - rest
                total[:, :k] += y.T @ (y @ q)
                total[:, k] += (y * y).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), *(pa.array(total[:, i]) for i in range(k + 1))], ["dim", *names])

        rows = self.blocks.mapInArrow(multiply, "dim long, " + ", ".join(f"{c} double" for c in names))
        out = np.array([list(r)[1:] for r in sorted(rows.groupBy("dim").agg(*(F.sum(c).alias(c) for c in names)).collect())]) / self.n
        shared.destroy()
        return out[:, :k], out[:, k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for raw, d in zip(batch.column("block"), batch.column("d").to_pylist(), strict=True):
            if d:
                yield np.frombuffer(raw.as_buffer(), dtype="<i8").reshape(-1, d)


def orthonormal(parts: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of all columns; what the ones before nearly span is left out. The first part's span is kept whole."""
    basis = np.zeros((len(parts[0]), 0))
    for part in parts:
        norms = np.linalg.norm(part, axis=0)
        some = part[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            some = some - basis @ (basis.T @ some)
        if some.size:
            u, s, _ = np.linalg.svd(some, full_matrices=False)
            u = u[:, s > 1e-8]
            u = u - basis @ (basis.T @ u)
            basis = np.concatenate((basis, np.linalg.qr(u)[0]), axis=1)[:, : len(basis)]
    return basis


def lobpcg(products: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], d: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float, list[float]]:
    """Largest eigenvalues, their unit vectors as columns, the trace, and the certified residuals, of the matrix that products() applies."""
    m = min(d, wanted + GUARD)
    q, before = orthonormal([np.random.default_rng(11).standard_normal((d, m))]), np.inf
    for _ in range(MOST_TURNS):
        vq, diagonal = products(q)
        t = q.T @ vq
        values, c = np.linalg.eigh((t + t.T) / 2)
        values, c = values[::-1][:m], c[:, ::-1][:, :m]
        x, vx = q @ c, vq @ c
        residual = vx - x * values
        sizes = np.linalg.norm(residual[:, :wanted], axis=0)
        scale, worst = max(float(values[0]), 0.0), float(sizes.max())
        if worst <= CERTIFIED * scale and worst > before / 2 or worst == 0:
            return values[:wanted], x[:, :wanted], float(diagonal.sum()), sizes.tolist()
        before = min(before, worst)
        moved = q[:, m:] @ c[m:]  # the step without its part along the iterate before
        q = orthonormal([x, residual, moved])
    raise RuntimeError(f"residuals of {worst:.3g} are not certified after {MOST_TURNS} turns")


class Whitening:
    """Components as columns, falling eigenvalues, their shares of the trace, and how far whitened points are from unit covariance."""

    def __init__(self, points: Points, components: int = COMPONENTS):
        self.points = points
        values, vectors, trace, self.residuals = lobpcg(points.products, points.d, min(components, points.d)) if points.d else (np.zeros(0), np.zeros((0, 0)), 0.0, [])
        real = values > RANK * max(values[0], 0.0) if len(values) else values > 0
        self.values, self.vectors, self.trace = values[real], vectors[:, real], trace
        self.explained = self.values / trace if trace else self.values
        self.identity_error = self._error() if real.any() else 0.0

    def projection(self) -> _Projection:
        return _Projection(self.vectors, self.values)

    def _error(self) -> float:
        """Over all points once more: means and products of the whitened values themselves."""
        k, whole, rest, project = len(self.values), self.points.whole, self.points.rest, self.projection()

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for b in _blocks(batches):
                z = project((b - whole) - rest)
                total[:k] += z.T @ z
                total[k] += z.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1)), *(pa.array(total[:, i]) for i in range(k))], ["row", *(f"c{i}" for i in range(k))])

        rows = self.points.blocks.mapInArrow(gather, "row long, " + ", ".join(f"c{i} double" for i in range(k)))
        total = np.array([list(r)[1:] for r in sorted(rows.groupBy("row").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(k))).collect())]) / self.points.n
        return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


class _Projection:
    """Differences from the mean as whitened values; what tasks need of a model."""

    def __init__(self, vectors: np.ndarray, values: np.ndarray):
        self.vectors, self.values = vectors, values

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return (y @ self.vectors) / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of rows(x), which valid() gives."""
    return Whitening(Points(rows), components)


def whiten(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """key, deviation, whitened (an array of a value a component) for rows(key, x)."""
    points, project = model.points, model.projection()
    n, d, whole, rest, remainder = points.n, points.d, points.whole, points.rest, points.remainder
    small = d * points.most**2 < 2**63

    def exact(away: np.ndarray) -> list[int | None]:
        if small:
            return ((away * n - np.array(remainder, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        sums = [sum((int(a) * n - r) ** 2 for a, r in zip(row, remainder, strict=True)) for row in away]
        return [s if s < 2**63 else None for s in sums]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - whole
                made = [batch.column(key), pa.array(exact(away), pa.int64()), pa.array(list(project(away - rest)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(made, [key, "deviation", "whitened"])

    return rows.select(key, "x").mapInArrow(apply, f"`{key}` {type_of(rows, key)}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = fit(rows)
    if not len(model.values):
        return spark.createDataFrame([], f"vec_id {type_of(rows, 'vec_id')}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.element_at(F.array(*(F.lit(float(v)) for v in model.explained)), F.col("component"))
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    each = each.select("vec_id", (F.col("at") + 1).alias("component"), "deviation", "whitened")
    return each.select("vec_id", "component", F.lit(model.points.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
