"""Fusing the scores of several methods into one.

Rows are wide: one double column per method, in the order of ``fixed.METHODS``.
Weights are a few numbers per method, fetched once and used as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.operators.scores import knn_score, scale_by_max
from duskwatch.plans.ordering import freeze


def _add(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def to_long(rows: DataFrame, key: str, methods: Sequence[str] = fixed.METHODS) -> DataFrame:
    return rows.unpivot([key], list(methods), "method", "score")


def variance_weights(scores: DataFrame, eps: float = 1e-8) -> DataFrame:
    """``method, variance, weight`` of long scores; uniform when all variances vanish."""
    spread = scores.groupBy("method").agg(F.coalesce(F.var_pop("score"), F.lit(0.0)).alias("variance"))
    total = spread.agg(F.sum("variance"), F.count(F.lit(1))).first()
    if not total[0] or total[0] <= eps:
        return spread.withColumn("weight", F.lit(1.0 / max(total[1], 1)))
    return spread.withColumn("weight", F.col("variance") / F.lit(total[0] + eps))


def ordered_weights(weights: DataFrame, methods: Sequence[str] = fixed.METHODS) -> DataFrame:
    """Weights in detector order, summing to one; uniform when all are zero."""
    known = {r["method"]: r["weight"] for r in weights.filter(F.col("method").isin(*methods)).collect()}
    values = [known.get(m, 0.0) for m in methods]
    total = sum(values)
    final = [v / total for v in values] if total > 0 else [1.0 / len(methods)] * len(methods)
    spark = weights.sparkSession
    return spark.createDataFrame(list(zip(range(len(methods)), methods, final)), "position INT, method STRING, weight DOUBLE")


def variance_bands(weights: DataFrame) -> DataFrame:
    """Words for how well each method separates, relative to the largest variance."""
    top = weights.agg(F.max("variance")).first()[0]
    relative = F.col("variance") / F.lit(top) if top else F.lit(None).cast("double")
    label = None
    for bound, text in fixed.VARIANCE_BANDS:
        label = F.when(relative > bound, text) if label is None else label.when(relative > bound, text)
    return weights.withColumn("quality", F.when(relative.isNotNull(), label.otherwise(fixed.VARIANCE_LOWEST)))


def softmax(weights: Sequence[float]) -> list[float]:
    top = max(weights)
    powers = [math.exp(w - top) for w in weights]
    return [p / sum(powers) for p in powers]


def fuse_max(rows: DataFrame, methods: Sequence[str] = fixed.METHODS, out: str = "ensemble") -> DataFrame:
    return rows.withColumn(out, F.greatest(*methods))


def max_shares(rows: DataFrame, methods: Sequence[str] = fixed.METHODS) -> DataFrame:
    """Share of rows each method decides under max fusion; the first method wins a tie."""
    top = F.greatest(*methods)
    winner = F.coalesce(*[F.when(F.col(m) == top, F.lit(m)) for m in methods])
    one = rows.select(winner.alias("_w")).agg(
        *[F.avg((F.col("_w") == m).cast("double")).alias(m) for m in methods]
    )
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("weight")) for m in methods]))
    )


def fuse_mean(rows: DataFrame, methods: Sequence[str] = fixed.METHODS, out: str = "ensemble") -> DataFrame:
    return rows.withColumn(out, _add([F.col(m) for m in methods]) / len(methods))


def fuse_weighted(rows: DataFrame, weights: Sequence[float], methods: Sequence[str] = fixed.METHODS, out: str = "ensemble") -> DataFrame:
    return rows.withColumn(out, _add([F.col(m) * F.lit(float(w)) for m, w in zip(methods, weights, strict=True)]))


def fuse_static(rows: DataFrame, weights: Sequence[float] | None = None, methods: Sequence[str] = fixed.METHODS, out: str = "ensemble") -> DataFrame:
    """Softmax of given weights (equal by default) times the scores."""
    return fuse_weighted(rows, softmax(weights or [1.0 / len(methods)] * len(methods)), methods, out)


def fuse_dynamic(rows: DataFrame, uniform: bool = False, methods: Sequence[str] = fixed.METHODS, out: str = "ensemble") -> DataFrame:
    """Weights by the variance each method shows on these rows, or equal weights."""
    if uniform:
        return fuse_weighted(rows, [1.0 / len(methods)] * len(methods), methods, out)
    spread = rows.agg(*[F.coalesce(F.var_pop(m), F.lit(0.0)).alias(m) for m in methods]).first()
    values = [spread[m] for m in methods]
    total = sum(values)
    weights = [v / total for v in values] if total > 1e-8 else [1.0 / len(methods)] * len(methods)
    return fuse_weighted(rows, weights, methods, out)


def fuse(rows: DataFrame, how: str = "dynamic_weight", **options) -> DataFrame:
    ways = {"max": fuse_max, "mean": fuse_mean, "static_weight": fuse_static, "dynamic_weight": fuse_dynamic}
    if how not in ways:
        raise ValueError(f"fusion must be one of {sorted(ways)}")
    return ways[how](rows, **options)


def choose_method(rows: DataFrame, method: str, out: str = "score") -> DataFrame:
    """The score column of a method; an unknown method means the ensemble."""
    return rows.withColumn(out, F.col(method if method in fixed.METHODS else "ensemble"))


def knn_enhanced(rows: DataFrame, bank: DataFrame, key: str, base: str = "score", vec: str = "vec", out: str = "score") -> DataFrame:
    """Mean of a base score and the kNN score scaled by its maximum."""
    found = freeze(knn_score(rows, bank, key, vec=vec, out="_knn"))
    return scale_by_max(found, "_knn").withColumn(out, (F.col(base) + F.col("_knn")) / 2).drop("_knn")


def batch_weights(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean weight and mean batch statistics per method over ``(batch, method)`` rows."""
    mean_weight = weights.groupBy("method").agg(F.avg("weight").alias("weight"))
    per_batch = scores.groupBy("batch", "method").agg(
        F.min("score").alias("min"), F.max("score").alias("max"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")
    )
    stats = per_batch.groupBy("method").agg(*[F.avg(c).alias(c) for c in ("min", "max", "mean", "std")])
    return mean_weight.join(stats, "method")
