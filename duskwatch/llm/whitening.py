"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import freeze, packed, unpacked
from duskwatch.llm.integer_vectors import column_sums, floored, largest, pack, summed, usable

SCALE = 256
COMPONENTS = 4
# Relative size at which a new Lanczos vector counts as zero, and at which a
# correction is large enough to orthogonalise once more.
VANISHED = 1e-12
UNSETTLED = 1e-9
ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass
class Whitening:
    """What a fit knows: small whatever the number of rows."""

    n: int
    sums: list[int]
    components: np.ndarray  # one unit vector per column
    variances: np.ndarray  # falling
    trace: float
    identity_error: float | None


def bidiagonalise(blocks: DataFrame, mean: np.ndarray, steps: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``V`` (orthonormal columns) and upper bidiagonal ``B`` with ``X V = U B`` for the centred rows ``X``.

    A left vector has one entry per row, so it is never stored: ``u = X w`` for a
    short ``w``, and every step is one job that forms ``p = X w``, ``X'p`` and the
    products of ``p`` with all earlier left vectors. These products correct ``p``
    (left reorthogonalisation); the new right vector is corrected against all
    earlier right vectors twice. A vector that vanishes is replaced by a fresh
    direction, so equal singular values are all found when ``steps`` is the
    number of columns.
    """
    dim = len(mean)
    draw = np.random.default_rng(seed)
    right = np.zeros((dim, 0))
    short = np.zeros((dim, 0))  # left vectors as combinations of the columns of X
    image = np.zeros((dim, 0))  # X' times the left vectors
    upper = np.zeros((steps, steps))

    def fresh() -> np.ndarray:
        v = draw.standard_normal(dim)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    def visit(w: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        count = earlier.shape[1]

        def measure(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            p = centred @ w
            return np.concatenate([centred.T @ p, (centred @ earlier).T @ p, [p @ p]])

        out = np.array(summed(blocks, measure, dim + count + 1), float)
        return out[:dim], out[dim:-1], out[-1]

    v, beta, scale = fresh(), 0.0, 0.0
    for j in range(steps):
        right = np.column_stack([right, v])
        w = v - beta * short[:, -1] if j and beta else v
        for _ in range(3):
            g, against, square = visit(w, short)
            w, g = w - short @ against, g - image @ against
            square = max(square - against @ against, 0.0)
            if against @ against <= (UNSETTLED**2) * square:
                break
        alpha = float(np.sqrt(square))
        scale = max(scale, alpha)
        if alpha <= VANISHED * scale or alpha == 0.0:
            alpha, w, g = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, g = w / alpha, g / alpha
        short, image = np.column_stack([short, w]), np.column_stack([image, g])
        upper[j, j] = alpha
        if j + 1 == steps:
            break
        following = g - alpha * v
        for _ in range(2):
            following = following - right @ (right.T @ following)
        beta = float(np.linalg.norm(following))
        scale = max(scale, beta)
        if beta <= VANISHED * scale or beta == 0.0:
            beta, v = 0.0, fresh()
        else:
            v = following / beta
        upper[j, j + 1] = beta
    return right, upper


def fit(rows: DataFrame, x: str = "x", components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """Leading principal components of the distinct integer vectors in ``x``; None without rows.

    All vectors must have one length. ``steps`` bounds the Lanczos steps (one job
    each); None takes as many as there are columns, which is exact also for
    repeated eigenvalues.
    """
    distinct = rows.select(F.col(x).alias("x")).distinct().select(F.lit(None).cast("bigint").alias("id"), "x")
    blocks = freeze(pack(freeze(distinct), "id", "x"))
    first = blocks.select("dim").first()
    if first is None:
        return None
    dim = first[0]
    totals = summed(blocks, lambda m: [*column_sums(m), len(m)], dim + 1, exact=True)
    n, sums = totals[-1], totals[:-1]
    if dim == 0:
        return Whitening(n, [], np.zeros((0, 0)), np.zeros(0), 0.0, None)
    mean = np.array([s / n for s in sums])
    right, upper = bidiagonalise(blocks, mean, min(steps or dim, dim))
    _, singular, turned = np.linalg.svd(upper)
    kept = min(components, len(singular))
    directions = right @ turned[:kept].T
    directions /= np.linalg.norm(directions, axis=0)
    variances = singular[:kept] ** 2 / n
    variances[variances <= (singular[0] ** 2 / n) * 1e-24] = 0.0
    live = variances > 0
    weights = directions[:, live] / np.sqrt(variances[live])
    r = int(live.sum())

    def moments(m: np.ndarray) -> np.ndarray:
        centred = m - mean
        z = centred @ weights
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel(), [(centred * centred).sum()]])

    out = np.array(summed(blocks, moments, r + r * r + 1), float)
    off = out[:r] / n
    covariance = out[r:-1].reshape(r, r) / n - np.outer(off, off)
    error = float(np.abs(covariance - np.eye(r)).max()) if r else None
    return Whitening(n, sums, directions, variances, out[-1] / n, error)


def whiten(rows: DataFrame, vec: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, steps: int | None = None) -> DataFrame:
    """The columns of ``rows`` and, per component, ``component, n, deviation, whitened, explained, identity_error``.

    Vectors become ``floor(scale * entry)``; components are fitted on each distinct
    vector once, every row (repeated ones too) is projected. Rows whose vector is
    null or holds a null or an entry that is not finite are left out, and so are
    vectors of another length than the most frequent one (of equally frequent
    lengths: the longest). An empty vector has no component and gives no row.
    ``deviation`` is a decimal, null beyond 38 digits. A component without
    variance has a null ``whitened``; ``explained`` is null where nothing varies.
    Null ids are kept like any id; input columns named like a result are replaced.
    """
    held = packed(rows, vec)
    good = held.where(usable(vec)).withColumn("_x", floored(vec, scale))
    sizes = good.groupBy(F.size("_x").alias("dim")).count()
    common = sizes.orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    good = good.where(F.size("_x") == F.lit(common["dim"] if common else 0))
    fitted = fit(good, "_x", components, steps)
    n, sums = (fitted.n, fitted.sums) if fitted else (1, [])
    live = fitted.variances > 0 if fitted else np.zeros(0, bool)
    directions = fitted.components if fitted else np.zeros((0, 0))
    spread = np.sqrt(np.where(live, fitted.variances, 1.0)) if fitted else np.zeros(0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            m = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
            z = ((m - np.array([s / n for s in sums])) @ directions) / spread
            far = n * largest(m) + max((abs(s) for s in sums), default=0)
            kind = np.int64 if len(sums) * far * far < 1 << 63 else object
            gap = n * m.astype(kind) - np.array(sums, dtype=kind)
            square = (gap * gap).sum(axis=1).tolist()
            decimals = pa.array([Decimal(s) if s < 10**38 else None for s in square], pa.decimal128(38, 0))
            whole = [[v if ok else None for v, ok in zip(row, live)] for row in z.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], decimals, pa.array(whole, pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "deviation", "z"],
            )

    schema = good.drop("_x").withColumns(
        {"deviation": F.lit(None).cast("decimal(38,0)"), "z": F.lit(None).cast("array<double>")}
    ).schema
    shares = [float(e / fitted.trace) if fitted.trace > 0 else None for e in fitted.variances] if fitted else []
    explained = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    long = good.mapInArrow(project, schema).select("*", F.posexplode("z").alias("_at", "whitened"))
    found = long.withColumns(
        {
            "component": F.col("_at") + 1,
            "n": F.lit(n).cast("bigint"),
            "explained": F.get(explained, F.col("_at")),
            "identity_error": F.lit(fitted.identity_error if fitted else None).cast("double"),
        }
    )
    return found.select(*unpacked(rows.columns, (vec,), ADDED))
