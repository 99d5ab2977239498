"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

An entry c becomes the whole number floor(256 * c), so counts and sums are exact. The fit list holds each distinct vector once. Its
centred scatter is added up by the tasks, one upper triangle each, and only that matrix reaches the driver. There it is factored with
diagonal pivoting into a lower trapezoid; plane rotations then make the factor's columns orthogonal. Their squared lengths are the
eigenvalues, and the columns, brought to length one, are the components.

What the driver holds is a square of the dimension, whatever the number of vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

SCALE = 256
#: Whole numbers of at most this size: a vector with a larger entry is no vector of this operator.
LARGEST = 2.0**52
WIDE = "decimal(38,0)"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id, x` of the rows that count: x holds floor(256 * c) of each entry.

    Left out are null and empty vectors, those with a null, a non-finite or an entry over 2^44 in size, and those that are not as long as
    most of the rest (the longer of two lengths equally frequent counts)."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fit = F.forall(c, lambda v: v.isNotNull() & (F.abs(v) <= LARGEST / SCALE))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.size(vector_col) > 0, c).alias("c")).where(F.col("c").isNotNull() & fit)
    size = rows.groupBy(F.size("c").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    rows = rows.where(F.size("c") == (size["dims"] if size else 0))
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE)).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


@dataclass
class Whitening:
    """The mean as exact sums over `n` vectors, the components as columns, all eigenvalues in falling order, and how far the fit list's
    whitened covariance is from the identity at most."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values[: self.components.shape[1]]))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n. The whole part of the mean is taken off exactly, so that a large mean costs no digits."""
        whole = np.array([s // self.n for s in self.sums])
        return (x - whole).astype(float) - np.array([s % self.n for s in self.sums]) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of the squares of n * x - S, exact; None where no long holds one."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums])
        if (self.centred(x) ** 2).sum(1).max(initial=0.0) * float(self.n) ** 2 < 2.0**62:
            return (((x - whole) * self.n - rest) ** 2).sum(1).tolist()
        exact = ((((x - whole).astype(object) * self.n) - rest.astype(object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower trapezoid L and an order of the rows such that a[order][:, order] is L @ L.T; it stops where the rest is rounding."""
    a, d = a.copy(), len(a)
    order, factor, rank = np.arange(d), np.zeros((d, d)), 0
    left = np.diag(a).copy()
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    for k in range(d):
        p = k + int(left[k:].argmax())
        if left[p] <= least:
            break
        for rows in (order, left, factor):
            rows[[k, p]] = rows[[p, k]]
        factor[k, k] = np.sqrt(left[k])
        column = a[order[k + 1 :], order[k]] - factor[k + 1 :, :k] @ factor[k, :k]
        factor[k + 1 :, k] = column / factor[k, k]
        left[k + 1 :] -= factor[k + 1 :, k] ** 2
        rank = k + 1
    return factor[:, :rank], order


def orthogonal_columns(factor: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """The factor after rotations of pairs of its columns, all orthogonal. The pairs of a round are disjoint, so they are turned at once;
    a sweep of rounds meets each pair once, as in a round-robin tournament."""
    f = factor.copy()
    r = f.shape[1]
    seats = np.arange(r + r % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            i, j = seats[:half], seats[half:][::-1]
            here = (i < r) & (j < r)
            i, j = i[here], j[here]
            x, y = f[:, i], f[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) / np.sqrt(np.where(a * b > 0, a * b, 1))
            worst = max(worst, off.max(initial=0.0))
            turn = off > np.finfo(float).eps
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            f[:, i], f[:, j] = cos * x - sin * y, sin * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 8 * np.finfo(float).eps:
            break
    return f


def principal(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance in falling order, and unit eigenvectors as columns (the largest entry of each is positive)."""
    factor, order = pivoted_cholesky(scatter)
    turned = orthogonal_columns(factor)
    values = (turned * turned).sum(0)
    rank = np.argsort(-values, kind="stable")
    columns = np.zeros_like(turned)
    columns[order] = turned
    columns = columns[:, rank] / np.sqrt(values[rank])
    if columns.shape[1]:
        columns = columns * np.sign(columns[np.abs(columns).argmax(0), np.arange(columns.shape[1])])
    return values[rank], columns


def _products(of, schema: str = "i int, j int, v double"):
    """A task's sum of the outer products of `of(x)` over its vectors, the upper triangle as rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = of(batch.column("x"))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return run, schema


def _summed(rows: DataFrame, dims: int) -> np.ndarray:
    got = rows.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((dims, dims))
    i, j, v = (got[c].to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def fit(distinct: DataFrame, most: int = 4) -> Whitening | None:
    """Learn from `distinct` (x array<long>, all of one length, each vector once). None without a vector.

    At most `most` components, and none without variance: a component whose eigenvalue is rounding beside the largest has no whitening."""
    per_dim = distinct.select(F.posexplode("x").alias("dim", "v")).groupBy("dim")
    sums = per_dim.agg(F.sum(F.col("v").cast(WIDE)).cast(WIDE).alias("s"), F.count("*").alias("n")).orderBy("dim").collect()
    if not sums:
        return None
    found = Whitening(sums[0]["n"], [int(r["s"]) for r in sums], np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    dims, n = len(sums), found.n
    run, schema = _products(lambda column: found.centred(_matrix(column, dims)))
    scatter = _summed(distinct.mapInArrow(run, schema), dims) / n
    values, columns = principal(scatter)
    some = int((values > dims * np.finfo(float).eps * values.max(initial=0.0)).sum())
    k = min(most, some)
    found.values, found.components, found.trace = values, columns[:, :k], float(np.trace(scatter))
    if k:
        # Whitened vectors and a one beside them: their products give means and second moments at once.
        run, schema = _products(lambda column: np.column_stack([found.whitened(x := _matrix(column, dims)), np.ones(len(x))]))
        moments = _summed(distinct.mapInArrow(run, schema), k + 1) / n
        mean = moments[:k, k]
        found.identity_error = float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, most: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that counts and each component: `vec_id, component, n, deviation, whitened, explained, identity_error`.

    Rows that don't count are those named at `whole_vectors`. Rows alike each give their own rows, though the fit sees their vector once;
    ids may repeat or be null; other columns are ignored whatever their names. Components without variance are left out, so a table whose
    vectors are all alike gives no row, as an empty one does. Of equal eigenvalues (ties) any orthogonal pair of components is right; all
    rows share the one found. `deviation` is null where no long holds it.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col)
    model = fit(stored(rows.select("x").distinct(), "whitening-fit"), most)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = schema.replace("vec_id long", f"vec_id {kind}")
    if model is None or not model.components.shape[1]:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(model)

    def project(batches):
        model = sent.value
        k = model.components.shape[1]
        share = model.values[:k] / model.trace
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), len(model.sums))
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pc.take(pa.array(model.deviations(x), pa.int64()), each), pa.array(model.whitened(x).ravel()), pa.array(np.tile(share, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)
