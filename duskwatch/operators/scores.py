"""Outlier scores of vectors against a bounded bank, and score scaling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.operators.samples import hash_sample
from duskwatch.operators.neighbours import _matrix, _top, collect_bank, nearest
from duskwatch.plans.ordering import freeze

_LRD_FLOOR = 1e-10
SCORES = (*fixed.METHODS, "contrastive_distance")


def bank_is_fit(bank: DataFrame) -> bool:
    """A bank of fewer than ten vectors is not fitted and scores zero."""
    return bank.limit(fixed.BANK_MINIMUM).count() >= fixed.BANK_MINIMUM


def _zero(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.lit(0.0))


# --- distance scores ----------------------------------------------------------


def knn_score(rows: DataFrame, bank: DataFrame, key: str, k: int = fixed.KNN_NEIGHBOURS, vec: str = "vec", out: str = "knn", **options) -> DataFrame:
    """Mean distance to the ``k`` nearest bank vectors (a bank member meets itself)."""
    if not bank_is_fit(bank):
        return _zero(rows, out)
    found = nearest(rows, bank, k, key, vec, **options)
    return found.withColumn(out, mean_distance("neighbours", k)).drop("neighbours")


def mean_distance(neighbours: str, k: int) -> Column:
    distances = F.transform(F.slice(neighbours, 1, k), lambda n: n["distance"])
    return F.aggregate(distances, F.lit(0.0), lambda a, d: a + d) / F.size(distances)


def contrastive_distance(rows: DataFrame, queue: DataFrame, key: str, vec: str = "vec", out: str = "contrastive_distance") -> DataFrame:
    """Smallest cosine distance to the queue, scaled over the run; a constant run gives 0."""
    found = nearest(rows, queue, 1, key, vec, metric="cosine")
    raw = freeze(found.withColumn(out, F.get("neighbours", F.lit(0))["distance"]).drop("neighbours"))
    return scale_run(raw, [out], flat_is_zero=[out])


def recent_queue(rows: DataFrame, key: str, limit: int, vec: str = "vec", order: str | None = None) -> DataFrame:
    """The newest ``limit`` vectors as ``bank_id, vec``.

    Only keys and times are ordered; the chosen keys, bounded by the limit, then
    pick their vectors.
    """
    order = order or key
    narrow = rows.select(F.col(key).alias("bank_id"), F.col(order).alias("_at"))
    newest = narrow.orderBy(F.col("_at").desc(), F.col("bank_id").desc()).limit(limit).select("bank_id")
    vectors = rows.select(F.col(key).alias("bank_id"), F.col(vec).alias("vec"))
    return vectors.join(F.broadcast(newest) if limit <= 1_000_000 else newest, "bank_id", "left_semi")


# --- local outlier factor -----------------------------------------------------


def _edges(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col(key).alias("_q"), F.explode("neighbours").alias("_n")).select(
        "_q", F.col("_n.bank_id").alias("bank_id"), F.col("_n.distance").alias("_d")
    )


@dataclass
class Density:
    """A bank whose members know their k-distance ``kd`` and local reachability density ``lrd``."""

    bank: DataFrame
    edges: DataFrame


def fit_density(bank: DataFrame, k: int = fixed.LOF_NEIGHBOURS, **options) -> Density:
    """K-distances and densities of the members of a bank, and their neighbour edges."""
    own = freeze(nearest(bank.select("bank_id", "vec"), bank, k, "bank_id", "vec", skip_self=True, **options))
    k_distances = own.select("bank_id", F.element_at("neighbours", -1)["distance"].alias("kd"))
    edges = _edges(own, "bank_id")
    reach = F.greatest("_d", "kd")
    density = (
        edges.join(k_distances, "bank_id")
        .groupBy(F.col("_q").alias("bank_id"))
        .agg((1.0 / (F.avg(reach) + F.lit(_LRD_FLOOR))).alias("lrd"))
    )
    members = own.select("bank_id", "vec", F.element_at("neighbours", -1)["distance"].alias("kd"))
    return Density(freeze(members.join(density, "bank_id")), edges)


def novelty(neighbours: str) -> Column:
    """The local outlier factor minus the offset 1.5, of neighbours that carry ``kd`` and ``lrd``."""

    def mean(value) -> Column:
        return F.aggregate(F.transform(neighbours, value), F.lit(0.0), lambda a, x: a + x) / F.size(neighbours)

    reach = mean(lambda n: F.greatest(n["distance"], n["kd"])) + F.lit(_LRD_FLOOR)
    return mean(lambda n: n["lrd"]) * reach - F.lit(fixed.LOF_OFFSET)


def lof_novelty(rows: DataFrame, bank: DataFrame, key: str, k: int = fixed.LOF_NEIGHBOURS, vec: str = "vec", out: str = "lof", **options) -> DataFrame:
    """Local outlier factor of new vectors against the bank, minus the offset 1.5."""
    if not bank_is_fit(bank):
        return _zero(rows, out)
    fitted = fit_density(bank, k, **options)
    found = nearest(rows, fitted.bank, k, key, vec, carry=("kd", "lrd"), **options)
    return found.withColumn(out, novelty("neighbours")).drop("neighbours")


def lof(rows: DataFrame, key: str, k: int = fixed.LOF_NEIGHBOURS, vec: str = "vec", out: str = "lof", **options) -> DataFrame:
    """Local outlier factor of every vector among all the others."""
    bank = rows.select(F.col(key).alias("bank_id"), F.col(vec).alias("vec"))
    fitted = fit_density(bank, k, **options)
    density = fitted.bank.select("bank_id", "lrd")
    around = fitted.edges.join(density, "bank_id").groupBy("_q").agg(F.avg("lrd").alias("_around"))
    scored = around.join(density.withColumnRenamed("bank_id", "_q"), "_q").select(
        F.col("_q").alias(key), (F.col("_around") / F.col("lrd")).alias(out)
    )
    return rows.join(scored, key, "left")


# --- cluster and reconstruction scores ----------------------------------------


def fit_clusters(bank: DataFrame, k: int = fixed.CLUSTERS, seed: int = 7) -> np.ndarray:
    # the row solver also accepts banks with fewer distinct vectors than clusters
    model = KMeans(k=k, seed=seed, featuresCol="_f", solver="row").fit(
        bank.select(array_to_vector(F.col("vec").cast("array<double>")).alias("_f"))
    )
    return np.asarray(model.clusterCenters())


def cluster_score(rows: DataFrame, centres: np.ndarray, vec: str = "vec", out: str = "cluster") -> DataFrame:
    """Distance to the nearest of the cluster centres."""

    return _measured(rows, lambda matrix: _centre_distance(matrix, centres), vec, out)


def _centre_distance(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = matrix[:, None, :] - centres[None, :, :]
    return np.sqrt((gap * gap).sum(axis=2)).min(axis=1)


def _measured(rows: DataFrame, measure: Callable[[np.ndarray], np.ndarray], vec: str, out: str) -> DataFrame:
    """Add ``measure`` of the matrix of each Arrow batch of vectors."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series(measure(_matrix(vectors)) if len(vectors) else [], dtype="float64")

    return rows.withColumn(out, run(vec))


def fit_reconstruction(bank: DataFrame, k: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions of the bank."""
    vectors = bank.select(array_to_vector(F.col("vec").cast("array<double>")).alias("_f"))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("_f"))).first()[0]
    return mean.toArray(), model.pc.toArray()


def reconstruction_score(rows: DataFrame, fitted: tuple[np.ndarray, np.ndarray], vec: str = "vec", out: str = "reconstruction") -> DataFrame:
    """Squared error after projection on the principal directions and back."""
    return _measured(rows, lambda matrix: _left_over(matrix, fitted), vec, out)


def _left_over(matrix: np.ndarray, fitted: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, directions = fitted
    centred = matrix - mean
    left = centred - (centred @ directions) @ directions.T
    return (left * left).sum(axis=1)


# --- isolation forest ---------------------------------------------------------


def _path_norm(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(sample: np.ndarray, rng: np.random.Generator, depth: int) -> list[list]:
    """Nodes ``[feature, split, left, right, path]``; a leaf has feature -1."""
    nodes: list[list] = []

    def node(rows: np.ndarray, level: int) -> int:
        place = len(nodes)
        nodes.append([-1, 0.0, place, place, level + _path_norm(len(rows))])
        varied = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if level >= depth or len(varied) == 0:
            return place
        feature = int(rng.choice(varied))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        split = float(rng.uniform(low, high))
        goes_left = rows[:, feature] <= split
        left, right = node(rows[goes_left], level + 1), node(rows[~goes_left], level + 1)
        nodes[place] = [feature, split, left, right, 0.0]
        return place

    node(sample, 0)
    return nodes


def fit_forest(bank: DataFrame, trees: int = fixed.TREES, sample: int = fixed.TREE_SAMPLE, seed: int = 7) -> DataFrame:
    """Isolation trees ``tree, node, feature, split, left, right, path``, grown one per task row.

    The rows come from a hash sample of at most ``trees * sample`` vectors, so the
    bank may have any size. Each tree has its own seed, so a lost task grows the
    same tree again.
    """
    spark = bank.sparkSession
    # Each tree draws its rows from these; more than all trees can take are not fetched.
    drawn = hash_sample(bank.select("bank_id", "vec"), "bank_id", trees * sample).orderBy("bank_id").toPandas()
    shared = spark.sparkContext.broadcast(_matrix(drawn["vec"]))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = shared.value
        size = min(sample, len(vectors))
        depth = int(np.ceil(np.log2(max(size, 2))))
        for batch in batches:
            for tree in batch["id"].tolist():
                rng = np.random.default_rng([seed, tree])
                chosen = vectors[rng.choice(len(vectors), size, replace=False)]
                frame = pd.DataFrame(_grow(chosen, rng, depth), columns=["feature", "split", "left", "right", "path"])
                frame.insert(0, "node", np.arange(len(frame)))
                frame.insert(0, "tree", tree)
                yield frame

    return spark.range(trees).mapInPandas(
        grow, "tree bigint, node bigint, feature bigint, split double, left bigint, right bigint, path double"
    )


def collect_trees(forest: DataFrame) -> list[tuple]:
    """Per tree the node columns; a forest is bounded by its number of trees and their sample."""
    nodes = forest.orderBy("tree", "node").toPandas()
    return [
        tuple(part[c].to_numpy() for c in ("feature", "split", "left", "right", "path"))
        for _, part in nodes.groupby("tree")
    ]


def _isolation(matrix: np.ndarray, trees: list[tuple], sample_size: int) -> np.ndarray:
    norm = _path_norm(sample_size) or 1.0
    line = np.arange(len(matrix))
    total = np.zeros(len(matrix))
    for feature, split, left, right, path in trees:
        at = np.zeros(len(matrix), dtype=np.int64)
        inner = feature[at] >= 0
        while inner.any():
            value = matrix[line, np.where(inner, feature[at], 0)]
            step = np.where(value <= split[at], left[at], right[at])
            at = np.where(inner, step, at)
            inner = feature[at] >= 0
        total += path[at]
    return np.power(2.0, -(total / len(trees)) / norm) - 0.5


def forest_score(rows: DataFrame, forest: DataFrame, sample_size: int, vec: str = "vec", out: str = "iforest") -> DataFrame:
    """``2^(-mean path / c(n)) - 0.5`` over all trees; the forest is bounded by its tree count."""
    shared = rows.sparkSession.sparkContext.broadcast(collect_trees(forest))
    return _measured(rows, lambda matrix: _isolation(matrix, shared.value, sample_size), vec, out)


# --- all methods in one visit ---------------------------------------------------


def all_scores(
    rows: DataFrame, density: Density, centres: np.ndarray, directions: tuple[np.ndarray, np.ndarray], forest: DataFrame, sample_size: int, vec: str = "vec",
    limit: int | None = None,
) -> DataFrame:
    """Add the raw scores ``knn, cluster, lof, iforest, reconstruction`` and ``contrastive_distance``.

    With a bank within the broadcast limit every vector is visited once, in the
    partition it lies in: no column is shuffled. A larger bank is searched by
    cells (``nearest``), which moves vectors only, for the three scores that
    need neighbours.
    """
    spark = rows.sparkSession
    k, few = fixed.LOF_NEIGHBOURS, fixed.KNN_NEIGHBOURS
    trees = spark.sparkContext.broadcast(collect_trees(forest))
    small = collect_bank(density.bank, limit, carry=("kd", "lrd"))
    shared = spark.sparkContext.broadcast(small)

    @F.pandas_udf(", ".join(f"{c} double" for c in SCORES))
    def visit(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            if not len(vectors):
                yield pd.DataFrame({c: pd.Series(dtype="float64") for c in SCORES})
                continue
            matrix = _matrix(vectors)
            found = {
                "cluster": _centre_distance(matrix, centres),
                "iforest": _isolation(matrix, trees.value, sample_size),
                "reconstruction": _left_over(matrix, directions),
                "knn": np.nan,
                "lof": np.nan,
                "contrastive_distance": np.nan,
            }
            if shared.value is not None:
                ids, bank, known = shared.value
                gaps, places = map(np.stack, zip(*_top(matrix, bank, ids, k, "euclidean")))
                reach = np.maximum(gaps, known["kd"][places]).mean(axis=1) + _LRD_FLOOR
                found["knn"] = gaps[:, :few].mean(axis=1)
                found["lof"] = known["lrd"][places].mean(axis=1) * reach - fixed.LOF_OFFSET
                found["contrastive_distance"] = np.array([d[0] for d, _ in _top(matrix, bank, ids, 1, "cosine")])
            yield pd.DataFrame(found, index=range(len(matrix)))[list(SCORES)]

    visited = rows.withColumn("_all", visit(vec))
    if small is not None:
        return visited.withColumns({c: F.col(f"_all.{c}") for c in SCORES}).drop("_all")
    visited = visited.withColumns({c: F.col(f"_all.{c}") for c in ("cluster", "iforest", "reconstruction")}).drop("_all")
    near = nearest(visited, density.bank, k, "", vec, limit=limit, carry=("kd", "lrd"))
    scored = near.withColumns({"knn": mean_distance("neighbours", few), "lof": novelty("neighbours")}).drop("neighbours")
    angle = nearest(scored, density.bank.select("bank_id", "vec"), 1, "", vec, metric="cosine", limit=limit)
    return angle.withColumn("contrastive_distance", F.get("neighbours", F.lit(0))["distance"]).drop("neighbours")


# --- scaling ------------------------------------------------------------------


def scale_run(rows: DataFrame, columns: Sequence[str], flat_is_zero: Sequence[str] = ()) -> DataFrame:
    """Min-max scaling of each column over the run; a constant column is clipped to [0, 1], or zero if named."""
    bounds = rows.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    ).first()
    changes = {}
    for c in columns:
        low, high = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if low is not None and high > low:
            changes[c] = (F.col(c) - F.lit(low)) / (F.lit(high) - F.lit(low))
        elif c in flat_is_zero:
            changes[c] = F.lit(0.0)
        else:
            changes[c] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    return rows.withColumns(changes)


def scale_methods(scores: DataFrame) -> DataFrame:
    """The same for long ``(method, score)`` rows, per method."""
    bounds = scores.groupBy("method").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    joined = scores.join(bounds, "method")
    spread = F.col("_hi") - F.col("_lo")
    scaled = F.when(spread > 0, (F.col("score") - F.col("_lo")) / spread).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    )
    return joined.withColumn("score", scaled).drop("_lo", "_hi")


def scale_by_stats(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Scaling by stored ``(method, min, max)`` with values outside clamped."""
    joined = scores.join(stats.select("method", F.col("min").alias("_lo"), F.col("max").alias("_hi")), "method")
    spread = F.col("_hi") - F.col("_lo")
    scaled = F.when(spread > 0, (F.col("score") - F.col("_lo")) / spread).otherwise(F.col("score"))
    return joined.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("_lo", "_hi")


def scale_by_max(rows: DataFrame, column: str) -> DataFrame:
    """``x / (max + 1e-10)`` over the run."""
    top = rows.agg(F.max(column)).first()[0]
    return rows.withColumn(column, F.col(column) / (F.lit(top if top is not None else 1.0) + F.lit(1e-10)))


def score_stats(scores: DataFrame) -> DataFrame:
    """Running ``min, max, sum, count`` per method."""
    return scores.groupBy("method").agg(
        F.min("score").alias("min"), F.max("score").alias("max"), F.sum("score").alias("sum"), F.count("score").alias("count")
    )


def merge_stats(known: DataFrame, fresh: DataFrame) -> DataFrame:
    return known.unionByName(fresh).groupBy("method").agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count")
    )
