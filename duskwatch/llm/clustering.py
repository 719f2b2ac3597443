"""Exact k-means on integer vectors with ns-bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import freeze
from duskwatch.llm.integer_vectors import floored, largest, matrix, pack, products, usable

SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
# Bounds are widened by this share, so that rounding never hides a nearer centroid.
SLACK = 1e-9
STATE = (
    "ids array<bigint>, dim int, x binary, cluster binary, distance binary, since binary, low binary, "
    "seen binary, tally array<struct<cluster:int,at:int,v:decimal(38,0)>>, evaluated bigint"
)
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    far = largest(x) + largest(centroids)
    if x.shape[1] * far * far < 1 << 53:
        own, theirs = (x * x).sum(axis=1), (centroids * centroids).sum(axis=1)
        return own[:, None] + theirs[None, :] - 2 * products(x, centroids)
    kind = np.int64 if x.shape[1] * far * far < 1 << 63 else object
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, centre in enumerate(centroids.astype(kind)):
        gap = x.astype(kind) - centre
        out[:, j] = np.minimum((gap * gap).sum(axis=1), (1 << 63) - 1).astype(np.int64)
    return out


def own_distances(x: np.ndarray, cluster: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row to the centroid of its cluster."""
    out = np.zeros(len(x), np.int64)
    for j in np.unique(cluster).tolist():
        rows = cluster == j
        out[rows] = distances(x[rows], centroids[j : j + 1])[:, 0]
    return out


def moves(history: np.ndarray) -> np.ndarray:
    """``[s, j]``: length of the total displacement of centroid ``j`` from round ``s`` to the last round."""
    gap = (history - history[-1]).astype(np.float64)
    return np.sqrt((gap * gap).sum(axis=2)) * (1 + SLACK)


def assign(state: dict, history: np.ndarray) -> int:
    """Bring one block up to the last round of ``history``; returns how many distances were evaluated.

    Every vector keeps the exact distance to its own centroid as of round
    ``since`` and, per centroid, a lower bound that was exact in round ``seen``.
    Both are loosened by how far the centroid is now from where it was in that
    round. A centroid whose lower bound does not exceed the upper bound is
    evaluated anew, ties included, so cluster and distance order are exact.
    """
    x, now = state["x"], len(history) - 1
    centroids = history[now]
    k, n = len(centroids), len(x)
    line = np.arange(n)
    if now == 0:
        exact = distances(x, centroids)
        state["cluster"] = exact.argmin(axis=1).astype(np.int32)
        state["distance"] = exact[line, state["cluster"]]
        state["low"] = np.sqrt(exact.astype(np.float64)).astype(np.float64)
        state["since"] = np.zeros(n, np.int16)
        state["seen"] = np.zeros((n, k), np.int16)
        return n * k
    moved = moves(history)
    cluster = state["cluster"].copy()
    upper = np.sqrt(state["distance"].astype(np.float64)) * (1 + SLACK) + moved[state["since"], cluster]
    loosened = state["low"] * (1 - SLACK) - moved[state["seen"], np.arange(k)[None, :]]
    failing = loosened <= upper[:, None]
    failing[line, cluster] = False
    rows = np.flatnonzero(failing.any(axis=1))
    if not len(rows):
        return 0
    own = own_distances(x[rows], cluster[rows], centroids)
    state["distance"][rows], state["since"][rows] = own, now
    state["low"][rows, cluster[rows]], state["seen"][rows, cluster[rows]] = np.sqrt(own.astype(np.float64)), now
    evaluated = len(rows)
    tight = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    failing[rows] &= loosened[rows] <= tight[:, None]
    best, nearest = state["distance"].copy(), cluster.copy()
    for j in range(k):
        at = np.flatnonzero(failing[:, j])
        if not len(at):
            continue
        d = distances(x[at], centroids[j : j + 1])[:, 0]
        evaluated += len(at)
        state["low"][at, j], state["seen"][at, j] = np.sqrt(d.astype(np.float64)), now
        nearer = (d < best[at]) | ((d == best[at]) & (j < nearest[at]))
        best[at[nearer]], nearest[at[nearer]] = d[nearer], j
    changed = nearest != cluster
    state["cluster"][changed], state["distance"][changed], state["since"][changed] = nearest[changed], best[changed], now
    return evaluated


def _advance(history: np.ndarray, last: bool):
    """A visit of all blocks: assignments of this round, and per cluster the sums the driver needs.

    The tally holds entry sums and, at ``dim``, the count; in the last round the
    distances' sums instead, exact distances of all vectors included.
    """
    from decimal import Decimal

    k, dim = history.shape[1:]
    kinds = {"cluster": (np.int32, ()), "distance": (np.int64, ()), "since": (np.int16, ()), "low": (np.float64, (k,)), "seen": (np.int16, (k,))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                state = {"x": matrix(row["x"], dim, n)}
                if len(history) > 1:
                    for name, (kind, shape) in kinds.items():
                        state[name] = np.frombuffer(row[name], kind).reshape(n, *shape).copy()
                evaluated = assign(state, history)
                tally = []
                if last:
                    state["distance"] = own_distances(state["x"], state["cluster"], history[-1])
                for j in np.unique(state["cluster"]).tolist():
                    mine = state["cluster"] == j
                    if last:
                        tally.append((j, 0, sum(state["distance"][mine].tolist())))
                        continue
                    part = state["x"][mine]
                    wide = part if largest(part) * len(part) < 1 << 62 else part.astype(object)
                    tally += [(j, at, s) for at, s in enumerate([*wide.sum(axis=0).tolist(), len(part)])]
                out = {
                    "ids": row["ids"],
                    "dim": dim,
                    "x": row["x"],
                    **{name: state[name].astype(kind).tobytes() for name, (kind, _) in kinds.items()},
                    "tally": [{"cluster": j, "at": at, "v": Decimal(int(v))} for j, at, v in tally],
                    "evaluated": evaluated,
                }
                yield pa.RecordBatch.from_pylist([out], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [
        ("ids", pa.list_(pa.int64())),
        ("dim", pa.int32()),
        *[(name, pa.binary()) for name in ("x", "cluster", "distance", "since", "low", "seen")],
        ("tally", pa.list_(pa.struct([("cluster", pa.int32()), ("at", pa.int32()), ("v", pa.decimal128(38, 0))]))),
        ("evaluated", pa.int64()),
    ]
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector of the final blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(np.frombuffer(row["cluster"], np.int32)),
                    pa.array(np.frombuffer(row["distance"], np.int64)),
                ],
                ["vec_id", "cluster", "distance"],
            )


def first_centroids(kept: DataFrame, k: int, seed: str = SEED) -> np.ndarray:
    """The vectors of the ``k`` smallest hashes of ``seed:id``; a null id comes last, ties go by the vector."""
    rank = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    rows = kept.select(F.col("id").isNull().alias("none"), rank.alias("h"), "x").orderBy("none", "h", "x").limit(k)
    return np.array([r["x"] for r in rows.collect()], np.int64)


def cluster(
    rows: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = 64,
    ident: str = "vec_id",
    vec: str = "embedding",
    scale: int = SCALE,
    seed: str = SEED,
    report: dict | None = None,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Entries become ``floor(scale * entry)``; centroids stay integer (the floor of
    the mean), so every distance is exact and ties go to the smaller number. The
    result equals ``rounds`` rounds of plain assignment and update and one more
    assignment; ns-bounds only spare distances (``report["evaluated"]`` counts
    those computed, ``report["possible"]`` all).

    Vectors that are null, hold nulls or entries that are not finite, or have
    another length than ``dim`` are left out. Repeated rows each count. With
    fewer vectors than ``k`` every vector starts a centroid; an empty table gives
    no rows. Null ids are kept. Other columns are not read. Sums of distances
    beyond 64 bits are null.
    """
    spark = rows.sparkSession
    kept = rows.where(usable(vec)).select(F.col(ident).cast("bigint").alias("id"), floored(vec, scale).alias("x"))
    kept = kept.where(F.size("x") == dim)
    first = first_centroids(kept, k, seed)
    if not len(first):
        return spark.createDataFrame([], RESULT)
    state, history = freeze(pack(kept, "id", "x")), first[None, :, :]
    evaluated = total = 0
    for at in range(rounds + 1):
        last = at == rounds
        state = freeze(state.mapInArrow(_advance(history, last), STATE))
        if report is not None:
            done, count = state.agg(F.sum("evaluated"), F.sum(F.size("ids"))).first()
            evaluated, total = evaluated + done, total + count * len(first)
        tally = (
            state.select(F.explode("tally").alias("t"))
            .groupBy("t.cluster", "t.at")
            .agg(F.sum("t.v").alias("v"))
            .collect()
        )  # a number per centroid and dimension
        if not last:
            sums = {(r["cluster"], r["at"]): int(r["v"]) for r in tally}
            following = history[-1].copy()
            for j in {c for c, _ in sums}:
                following[j] = [sums[j, d] // sums[j, dim] for d in range(dim)]
            history = np.concatenate([history, following[None]])
    if report is not None:
        report.update(evaluated=evaluated, possible=total)
    inertia = {r["cluster"]: int(r["v"]) for r in tally}
    fits = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    known = spark.createDataFrame(
        [(j, fits(v), fits(sum(inertia.values())), digest[j]) for j, v in inertia.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    found = state.select("ids", "cluster", "distance").mapInArrow(_rows, "vec_id bigint, cluster int, distance bigint")
    return found.join(F.broadcast(known), "cluster").select("vec_id", *known.columns[:1], "distance", *known.columns[1:])
