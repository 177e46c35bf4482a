"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Entries become whole numbers, and each distinct vector is a row of the fit once. With X the centred rows, a step takes the
product X v of the newest right vector and the product of X transposed with the new left vector; both are one pass in
which every task returns sums of bounded size. Left vectors have an entry per row and are never gathered: each is X c for
a short vector c that the driver knows, so a task makes its part of all of them again from its rows, and both sides are
reorthogonalised in full, twice (the left side once from products that are known and once from the rows). Where a step meets an invariant subspace, a new direction is drawn and equal eigenvalues
are found too. The singular vectors of the small bidiagonal matrix give components and deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, written

SCALE, COMPONENTS = 256, 4
SEED = 13
TINY = 1e-14                # relative to the largest deviation
LONG = 1 << 63


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> list:
    """Sum over all batches of ``fn`` (from rows of x to ``size`` numbers), added up in each task and then by Spark."""
    ddl = f"at int, v {kind}"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], schema=schema)

    v = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    sums = rows.select("x").mapInArrow(run, ddl).groupBy("at").agg(F.sum(v).alias("v"))
    out = {r["at"]: int(r["v"]) if kind == "long" else r["v"] for r in sums.collect()}      # ``size`` rows
    return [out[i] for i in range(size)]


class Fit:
    """The rows of the fit, their number, exact sums and centre."""

    def __init__(self, rows: DataFrame, size: int):
        self.rows, self.size = rows, size
        self.n = rows.count()
        # Halves of the numbers, so that no sum leaves the range of a long.
        halves = summed(rows, lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), 2 * size, "long")
        self.sums = [(h << 32) + low for h, low in zip(halves[:size], halves[size:], strict=True)]
        self.mean = np.array([float(Fraction(s, self.n)) for s in self.sums])

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        mean = self.mean
        return lambda x: x.astype(np.float64) - mean

    def trace(self) -> float:
        of = self.centred()
        return summed(self.rows, lambda x: np.array([(of(x) ** 2).sum()]), 1)[0] / self.n

    def products(self, c: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """With w = X c: the products of w with the left vectors X ``left``, its squared norm, and X transposed with w."""
        of, size, known = self.centred(), self.size, left.shape[1]

        def fn(x):
            rows = of(x)
            w = rows @ c
            return np.concatenate([(rows @ left).T @ w, [w @ w], rows.T @ w])

        out = np.array(summed(self.rows, fn, known + 1 + size))
        return out[:known], float(out[known]), out[known + 1:]


def components(fit: Fit, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns) of the rows' covariance and their eigenvalues, the largest first; those without any
    deviation are left out. Ends when the ``wanted`` largest have settled to rounding, at the latest with all dimensions."""
    size, rng = fit.size, np.random.default_rng(SEED)
    right = np.empty((size, 0))         # v
    left = np.empty((size, 0))          # c: the left vector is X c
    image = np.empty((size, 0))         # X transposed with the left vectors
    alphas: list[float] = []
    betas: list[float] = []             # betas[j] ties left vector j to right vector j + 1

    def clean(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - right @ (right.T @ v)
        return v

    v, largest = rng.standard_normal(size), 0.0
    v /= np.linalg.norm(v)
    while True:
        right = np.column_stack([right, v])
        c = v - left @ (image.T @ v)            # the left vectors' products with X v are known from the other side
        h, norm, back = fit.products(c, left)
        c, back, alpha = c - left @ h, back - image @ h, np.sqrt(max(norm - h @ h, 0.0))
        largest = max(largest, alpha, *betas, 0.0)
        if alpha <= TINY * largest or not alpha:
            alpha, c, back = 0.0, np.zeros(size), np.zeros(size)       # X v lies in what is known: a left vector of no weight
        else:
            c, back = c / alpha, back / alpha
        left, image = np.column_stack([left, c]), np.column_stack([image, back])
        alphas.append(alpha)
        r = clean(back - alpha * v)
        beta = float(np.linalg.norm(r))
        b = np.diag(alphas) + np.diag(betas, 1)
        p, s, q = np.linalg.svd(b)
        if len(alphas) == size:
            break
        k = min(wanted, len(s))
        # What a triplet lacks is beta times the last entry of its left vector.
        if len(alphas) > 2 * wanted and beta > TINY * largest and (beta * np.abs(p[-1, :k + 1]) <= TINY * s[0]).all():
            break
        if beta <= TINY * largest:
            r, beta = clean(rng.standard_normal(size)), 0.0
        betas.append(beta)
        v = r / np.linalg.norm(r)
    good = s[:wanted] > 1e-10 * s[0] if s[0] > 0 else np.zeros(min(wanted, len(s)), bool)
    vectors = right @ q.T[:, :len(good)][:, good]
    return vectors / np.linalg.norm(vectors, axis=0), s[:len(good)][good] ** 2 / fit.n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S) squared; null beyond the range of a long."""
    size = x.shape[1]
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if size * most * most < LONG:
        d = n * x - np.array(sums, np.int64)
        return pa.array((d * d).sum(1))
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return pa.array([e if e < LONG else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out. An entry c counts as floor(scale c), held to the
    range of a long. The fit takes each distinct vector once. Vectors of different lengths are different tables, each with a
    fit of its own. Components without deviation (of one distinct vector, say, or beyond the rank) are left out, so a vector
    may have fewer rows than ``wanted`` or none. ``deviation`` is null where it exceeds a long. Rows with equal or null ids
    are vectors of their own. Other columns are not read. An empty table gives no rows.
    """
    entry = F.col(vector_column)
    fine = F.coalesce(F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = written(vectors.where(fine & (F.size(entry) > 0)).select(F.col(id_column), x.alias("x")))
    ddl = f"{id_column} {dict(vectors.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = rows.select(id_column).limit(0).selectExpr(id_column, *[f"cast(null as {t}) as {c}" for c, t in (f.split(" ") for f in ddl.split(", ")[1:])])
    for size in sorted(r.size for r in rows.select(F.size("x").alias("size")).distinct().collect()):        # one, as a rule
        part = rows.where(F.size("x") == size)
        fit = Fit(written(part.select("x").distinct()), size)
        found, values = components(fit, wanted)
        if len(values):
            out = out.unionByName(_projected(part, fit, found, values, ddl, id_column))
    return out


def _projected(part: DataFrame, fit: Fit, found: np.ndarray, values: np.ndarray, ddl: str, id_column: str) -> DataFrame:
    of, k, schema = fit.centred(), len(values), arrow_schema(ddl)
    to = found / np.sqrt(values)

    def moments(x):
        w = of(x) @ to
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    got = np.array(summed(fit.rows, moments, k * k + k)) / fit.n
    error = float(np.abs(got[:k * k].reshape(k, k) - np.outer(got[k * k:], got[k * k:]) - np.eye(k)).max())
    shares, n, sums = values / fit.trace(), fit.n, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            at = pa.array(np.repeat(np.arange(len(x)), k))
            m = len(at)
            columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, n)),
                       deviations(x, n, sums).take(at), pa.array((of(x) @ to).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return part.select(id_column, "x").mapInArrow(run, ddl)
