"""Evaluation of anomaly scores, with and without labels.

Curves group equal scores first and then need one distributed scan by falling
score; every figure derived from a curve is an aggregate over that scan. All
functions take long rows and an optional list of ``keys`` (such as ``method``)
to evaluate several score sets in one job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import excludes_all, score_band
from duskwatch.operators.features import build_bank
from duskwatch.operators.neighbours import _matrix
from duskwatch.operators.scores import lof
from duskwatch.plans.ordering import blocks, freeze, same_keys, scan
from duskwatch.plans.selection import before, bound_at, percentiles

# --- with labels ---------------------------------------------------------------


def curve(rows: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score, from high to low: ``pos, neg`` and running ``tp, fp``, and totals ``p, n``."""
    keys = list(keys)
    grouped = rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    totals = grouped.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    running = scan(grouped.withColumn("_down", -F.col("score")), ["_down"], keys, sums={"tp": "pos", "fp": "neg"})
    running = running.drop("_down")
    if keys:
        return same_keys(running, totals, keys)
    p, n = totals.first()
    # a small number would be an int, and the product of both may be beyond one
    return running.withColumns({"p": F.lit(p).cast("long"), "n": F.lit(n).cast("long")})


def areas(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (ties count half) and ``pr_auc`` (average precision) of a curve."""
    below = F.col("n") - F.col("fp")
    pairs = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    out = points.groupBy(*keys).agg(
        (pairs / F.nullif(F.max(F.col("p") * F.col("n")), F.lit(0))).alias("roc_auc"),
        (F.sum(F.col("pos") * precision) / F.nullif(F.max("p"), F.lit(0))).alias("pr_auc"),
    )
    return out


def roc_points(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``fpr, tpr, threshold`` per distinct score."""
    return points.select(
        *keys,
        (F.col("fp") / F.nullif(F.col("n"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("tpr"),
        F.col("score").alias("threshold"),
    )


def best_f1(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The lowest threshold with the largest F1 for predictions ``score >= threshold``."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.col("tp") / F.nullif(F.col("p"), F.lit(0))
    scored = points.withColumn("f1", 2 * precision * recall / (precision + recall + F.lit(1e-10)))
    # equal F1 values: the curve is searched from the lowest threshold up
    best = F.max_by(F.struct("score", "f1"), F.struct(F.col("f1"), -F.col("score")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.score").alias("threshold"), F.col("_b.f1").alias("f1")
    )


def label_summary(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum(F.col("label").cast("long")).alias("num_anomalies"),
        F.avg(F.col("label").cast("double")).alias("anomaly_ratio"),
    )


def evaluation_metrics(rows: DataFrame, model_name: str = "default") -> DataFrame:
    """One row: ``model_name, roc_auc, pr_auc, num_samples, num_anomalies, anomaly_ratio``."""
    keyed = rows.withColumn("model_name", F.lit(model_name))
    keys = ["model_name"]
    return areas(curve(keyed, keys), keys).join(label_summary(keyed, keys), keys)


def accuracy(rows: DataFrame, threshold: float | Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows where ``score > threshold`` agrees with the label."""
    limit = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    hit = (F.col("score") > limit).cast("int") == F.col("label")
    return rows.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("accuracy"))


def method_table(rows: DataFrame) -> DataFrame:
    """Per method: areas, best threshold and the accuracy at it, best method first."""
    keys = ["method"]
    points = freeze(curve(rows, keys))
    best = best_f1(points, keys)
    judged = rows.join(best.select("method", F.col("threshold").alias("_t")), "method")
    return (
        areas(points, keys)
        .join(best, keys)
        .join(accuracy(judged, F.col("_t"), keys), keys)
        .orderBy(F.col("roc_auc").desc_nulls_last(), "method")
    )


def class_histograms(rows: DataFrame, bins: int = 50, score: str = "score") -> DataFrame:
    """``label, bin, low, high, count``; each class has its own range, the last bin is closed."""
    return _histogram(rows, ["label"], bins, score)


def _histogram(rows: DataFrame, keys: list[str], bins: int, score: str = "score") -> DataFrame:
    """Non-empty bins of equal width between the smallest and largest score of the keys."""
    bounds = rows.groupBy(*keys).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    if keys:
        joined = same_keys(rows, bounds, keys)
    else:
        low, high = bounds.first()
        joined = rows.withColumns({"_lo": F.lit(low), "_hi": F.lit(high)})
    # a range of one value is widened by one half on both sides
    flat = F.col("_hi") == F.col("_lo")
    low = F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(score) - low) / width), F.lit(bins - 1))
    return joined.groupBy(*keys, at.alias("bin")).agg(
        F.first(low + at * width).alias("low"),
        F.first(low + (at + 1) * width).alias("high"),
        F.count(F.lit(1)).alias("count"),
    )


# --- distribution --------------------------------------------------------------


_QUANTILES = {"median": 0.5, "percentile_95": 0.95, "percentile_99": 0.99, "q1": 0.25, "q3": 0.75}


def distribution(rows: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Location, spread, shape and exact quantiles of scores."""
    keys = list(keys)
    column = F.col(score)
    mean, std, top = F.avg(column), F.stddev_pop(column), F.max(column)
    moments = rows.groupBy(*keys).agg(
        F.count(column).alias("num_samples"),
        mean.alias("mean"),
        std.alias("std"),
        F.min(column).alias("min"),
        top.alias("max"),
        (top - F.min(column)).alias("range"),
        F.skewness(column).alias("skewness"),
        F.kurtosis(column).alias("kurtosis"),
        ((top - mean) / F.nullif(std, F.lit(0.0))).alias("separation_index"),
    )
    quantiles = percentiles(rows, score, _QUANTILES, keys)
    if keys:
        both = same_keys(moments, quantiles, keys)
    else:
        both = moments.withColumns({n: F.lit(v).cast("double") for n, v in quantiles.first().asDict().items()})
    return both.withColumn("iqr", F.col("q3") - F.col("q1"))


def histogram_entropy(rows: DataFrame, bins: int = 30, score: str = "score") -> DataFrame:
    """Shannon entropy of a histogram, in bits."""
    counted = _histogram(rows, [], bins, score)
    total = rows.count()
    share = F.col("count") / F.lit(total)
    used = F.sum(share * F.log2(share + F.lit(1e-10)))
    return counted.agg((-used).alias("entropy"))


def kde_entropy(rows: DataFrame, grid: int = 100, score: str = "score") -> DataFrame:
    """``score_entropy`` and ``normalized_entropy`` of a Gaussian density on a grid.

    Each row is evaluated at all grid points inside one aggregation, so the data
    is read once and nothing is multiplied out.
    """
    low, high, n, spread = rows.agg(F.min(score), F.max(score), F.count(score), F.var_samp(score)).first()
    width = high - low
    scaled = (F.col(score) - F.lit(low)) / F.lit(width) if width > 0 else F.lit(0.0)
    # kernel variance by Scott's rule in one dimension
    variance = (spread / (width * width) if width > 0 else 0.0) * n ** (-2.0 / 5.0)
    if variance <= 0:
        return rows.sparkSession.createDataFrame([(None, None)], "score_entropy DOUBLE, normalized_entropy DOUBLE")
    points = [i / (grid - 1) for i in range(grid)]
    sums = rows.select(scaled.alias("_x")).agg(
        *[F.expr(f"sum(exp(-(_x - {g!r}D) * (_x - {g!r}D) / {2 * variance!r}D)) AS g{i}") for i, g in enumerate(points)]
    )
    density = sums.select(F.array(*[F.col(f"g{i}") for i in range(grid)]).alias("_d"))
    total = F.aggregate("_d", F.lit(0.0), lambda a, x: a + x)
    shares = density.select(F.transform("_d", lambda x: x / total).alias("_p"))
    entropy = -F.aggregate("_p", F.lit(0.0), lambda a, x: a + x * F.log2(x + F.lit(1e-10)))
    return shares.select(entropy.alias("score_entropy")).withColumn(
        "normalized_entropy", F.col("score_entropy") / F.log2(F.lit(float(grid)))
    )


def quality_label(skewness: Column, separation: Column) -> Column:
    return (
        F.when((skewness > 1.0) & (separation > 2.0), "good")
        .when((skewness > 0.5) & (separation > 1.5), "acceptable")
        .when((skewness <= 0.5) | (separation <= 1.0), "poor")
        .otherwise("moderate")
    )


def consistency(rows: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Separation, spread ratio, shares of high scores, shape and a quality label."""
    keys = list(keys)
    stats = distribution(rows, keys, score).select(
        *keys, "mean", "std", "max", "min", "iqr", "percentile_99", "skewness", "kurtosis"
    )
    if keys:
        joined = rows.join(stats, keys)
    else:
        one = stats.first().asDict()
        joined = rows.withColumns({c: F.lit(v) for c, v in one.items()})
    counted = joined.groupBy(*keys).agg(
        F.avg((F.col(score) > F.col("mean") + 2 * F.col("std")).cast("double")).alias("high_score_density"),
        F.avg((F.col(score) > F.col("percentile_99")).cast("double")).alias("very_high_score_density"),
        *[F.max(c).alias(c) for c in ("mean", "std", "max", "min", "iqr", "skewness", "kurtosis")],
    )
    separation = (F.col("max") - F.col("mean")) / (F.col("std") + F.lit(1e-10))
    ratio = F.when(F.col("iqr") > 0, F.col("iqr") / (F.col("max") - F.col("min") + F.lit(1e-10))).otherwise(F.lit(0.0))
    return counted.select(
        *keys,
        separation.alias("separation_index"),
        ratio.alias("iqr_range_ratio"),
        "high_score_density",
        "very_high_score_density",
        "skewness",
        "kurtosis",
        quality_label(F.col("skewness"), separation).alias("distribution_quality"),
    )


def method_statistics(rows: DataFrame) -> DataFrame:
    """Mean, deviation, maximum, separation and quality per method."""
    separation = (F.max("score") - F.avg("score")) / (F.stddev_pop("score") + F.lit(1e-10))
    return rows.groupBy("method").agg(
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("std"),
        F.max("score").alias("max"),
        separation.alias("separation_index"),
        quality_label(F.skewness("score"), separation).alias("distribution_quality"),
    )


def suggest_threshold(rows: DataFrame, method: str = "percentile", percentile: float = 95, score: str = "score") -> DataFrame:
    """One row ``threshold``; an unknown method means the 95th percentile."""
    if method == "std":
        return rows.agg((F.avg(score) + 2 * F.stddev_pop(score)).alias("threshold"))
    if method == "iqr":
        quartiles = percentiles(rows, score, {"q1": 0.25, "q3": 0.75})
        return quartiles.select((F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("threshold"))
    return percentiles(rows, score, {"threshold": (percentile if method == "percentile" else 95) / 100})


def exceedances(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return rows.filter(F.col(score) >= threshold)


def exceedance_ratio(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Count and share of scores at or above the threshold."""
    hit = F.col(score) >= threshold
    return rows.agg(
        F.count_if(hit).alias("num_anomalies"), (F.count_if(hit) / F.count(F.lit(1))).alias("anomaly_ratio")
    )


def unsupervised_summary(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Samples and anomalies for ``score > threshold``."""
    hit = F.col(score) > threshold
    return rows.agg(
        F.lit(threshold).alias("threshold"),
        F.count(F.lit(1)).alias("num_samples"),
        F.count_if(hit).alias("num_anomalies"),
        F.coalesce(F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("anomaly_ratio"),
    )


def simple_statistics(rows: DataFrame, score: str = "score") -> DataFrame:
    return distribution(rows, score=score).select("mean", "std", "max", "median", "percentile_95", "percentile_99")


# --- trend ---------------------------------------------------------------------


def trend(series: DataFrame, value: str = "score") -> DataFrame:
    """Slope and intercept over the index; zero for up to five points."""
    enough = F.count(value) > 5
    return series.agg(
        F.when(enough, F.regr_slope(F.col(value), F.col("idx"))).otherwise(F.lit(0.0)).alias("trend_slope"),
        F.when(enough, F.regr_intercept(F.col(value), F.col("idx"))).otherwise(F.lit(0.0)).alias("trend_intercept"),
    )


def autocorrelation(series: DataFrame, value: str = "score", most: int = 40, block: int = 100_000) -> DataFrame:
    """``lag, r, bound, significant`` for lags up to ``min(40, n / 2)``.

    All lagged products come from one pass over blocks of the index that carry
    the next rows of their neighbour. ``bound`` is 1.96 Bartlett deviations.
    """
    n, mean = series.agg(F.count(value), F.avg(value)).first()
    lags = min(most, n // 2)
    if lags < 1:
        return series.sparkSession.createDataFrame([], "lag INT, r DOUBLE, bound DOUBLE, significant BOOLEAN")
    order = Window.partitionBy("_block").orderBy("idx")
    centred = blocks(series.select("idx", (F.col(value) - F.lit(mean)).alias("_x")), "idx", lags, block, ahead=True)
    products = centred.select(
        "_own", "_x", *[(F.col("_x") * F.lead("_x", k).over(order)).alias(f"p{k}") for k in range(1, lags + 1)]
    ).filter("_own")
    total = F.sum(F.col("_x") * F.col("_x"))
    sums = products.agg(*[(F.sum(f"p{k}") / total).alias(f"r{k}") for k in range(1, lags + 1)])
    rows = sums.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"r{k}").alias("r")) for k in range(1, lags + 1)]))
    )
    earlier = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)  # at most 40 rows
    variance = (1 + 2 * F.coalesce(F.sum(F.col("r") * F.col("r")).over(earlier), F.lit(0.0))) / F.lit(float(n))
    return rows.withColumn("bound", 1.96 * F.sqrt(variance)).withColumn("significant", F.abs("r") > F.col("bound"))


def periodicity(correlations: DataFrame) -> DataFrame:
    """``has_periodicity`` and the strongest significant lag with its value."""
    strong = correlations.filter("significant")
    return strong.agg(
        (F.count(F.lit(1)) > 0).alias("has_periodicity"),
        F.max_by("lag", F.struct(F.abs("r"), -F.col("lag"))).alias("strongest_lag"),
        F.max_by("r", F.struct(F.abs("r"), -F.col("lag"))).alias("strongest_value"),
    )


def chronological_split(lines: DataFrame, ratio: float = 0.2, least: int = 100, from_head: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(train, eval)`` parts of indexed lines, cut once along the index."""
    total = lines.count()
    if total == 0:
        raise ValueError("there are no lines to split")
    held = min(max(least, int(total * ratio)), total // 2)
    if total - held < least:
        held = total // 4
    cut = F.col("idx") < held if from_head else F.col("idx") >= total - held
    return lines.filter(~cut), lines.filter(cut)


# --- features ------------------------------------------------------------------


def lof_agreement(rows: DataFrame, key: str, k: int | None = None, share: float = 0.1, **options) -> DataFrame:
    """How far scores agree with local outliers of the same rows.

    The ``share`` of rows with the largest factor is labelled 1, the rest -1
    (as a detector with that contamination would). Returns the correlation of
    label and score and the ratio of mean labels above and below the 90th
    percentile of the score, and both means.
    """
    total = rows.count()
    factors = freeze(lof(rows, key, k or min(20, total // 5), **options))
    limit = percentiles(factors, "lof", {"p": 1.0 - share}).first()[0]
    high = percentiles(factors, "score", {"p": 0.9}).first()[0]
    label = F.when(F.col("lof") > limit, 1.0).otherwise(-1.0)
    above = F.col("score") > high
    means = factors.select("score", label.alias("_l"), above.alias("_h")).agg(
        F.corr("_l", "score").alias("lof_correlation"),
        F.avg(F.when(F.col("_h"), F.col("_l"))).alias("high_score_mean"),
        F.avg(F.when(~F.col("_h"), F.col("_l"))).alias("rest_mean"),
    )
    return means.withColumn(
        "high_score_lof_ratio",
        F.coalesce(F.col("high_score_mean") / (F.col("rest_mean") + F.lit(1e-10)), F.lit(1.0)),
    )


def spatial_density(rows: DataFrame, key: str, k: int = 20, share: float = 0.1, **options) -> DataFrame:
    """Agreement of scores with local density, comparing the top tenth of the ranking with the rest."""
    factors = freeze(lof(rows, key, k, **options))
    total = factors.count()
    limit = percentiles(factors, "lof", {"p": 1.0 - share}).first()[0]
    label = F.when(F.col("lof") > limit, 1.0).otherwise(-1.0)
    narrow = factors.select(key, "score", label.alias("_l"))
    start, _ = bound_at(narrow, ["score", key], int(total * 0.9))
    top = ~before(narrow, ["score", key], start)
    return narrow.agg(
        F.corr("_l", "score").alias("lof_correlation"),
        F.avg(F.when(top, F.col("_l"))).alias("top10pct_density"),
        F.avg(F.when(~top, F.col("_l"))).alias("rest_density"),
    ).withColumn("density_ratio", F.col("top10pct_density") / (F.col("rest_density") + F.lit(1e-10)))


def mean_lof_label(rows: DataFrame, key: str, k: int = 20, vec: str = "vec") -> DataFrame:
    """Mean outlier label (1 where the factor is above 1.5, else -1) and mean factor, over all rows."""
    chosen = freeze(build_bank(rows, key, vec))
    factors = lof(chosen, "bank_id", k, "vec")
    return factors.agg(
        F.avg(F.when(F.col("lof") > fixed.LOF_OFFSET, 1.0).otherwise(-1.0)).alias("lof_score"),
        F.avg("lof").alias("mean_lof"),
    )


def class_separation(rows: DataFrame, key: str, vec: str = "vec", label: str = "label") -> DataFrame:
    """Silhouette, distance within the classes, centre distance and their ratio, over all rows.

    Distances are squared, as the sum of squared distances from ``x`` to all
    ``n`` rows of a class is ``n`` times that to its centre plus the class's own
    spread; so centres, counts and spreads are all a row has to know.
    ``intra_distance`` is the root of the mean squared distance of two rows of a
    class, averaged over the classes. Rows without vector or label are left out.
    The driver receives one row per class. ``key`` is not needed and kept for
    callers that name it.
    """
    known = rows.select(F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec")).filter(
        F.col("vec").isNotNull() & F.col("label").isNotNull()
    )
    dense = known.select("label", array_to_vector("vec").alias("v"))
    classes = dense.groupBy("label").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("v")).alias("m")).orderBy("label").collect()
    names = [r["label"] for r in classes]
    centres = np.array([r["m"].toArray() for r in classes])
    sizes = np.array([r["n"] for r in classes], dtype=np.float64)

    @F.pandas_udf("array<double>")
    def squares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            matrix = _matrix(vectors)
            yield pd.Series([[float(((x - c) ** 2).sum()) for c in centres] for x in matrix])

    place = F.coalesce(*[F.when(F.col("label") == F.lit(n), F.lit(i)) for i, n in enumerate(names)]) if names else F.lit(None).cast("int")
    measured = known.select(place.alias("at"), squares("vec").alias("gaps"))
    own = F.get("gaps", F.col("at"))
    spread = {r["at"]: r["s"] for r in measured.groupBy("at").agg(F.sum(own).alias("s")).collect()}
    spreads = [float(spread.get(i, 0.0)) for i in range(len(names))]

    count = lambda i: F.element_at(F.array(*[F.lit(float(n)) for n in sizes]), i + 1)
    held = lambda i: F.element_at(F.array(*[F.lit(v) for v in spreads]), i + 1)
    spark = rows.sparkSession
    if len(names) > 1:
        at = F.col("at")
        inner = (own * count(at) + held(at)) / (count(at) - 1)
        outer = F.array_min(F.filter(F.transform("gaps", lambda g, i: F.when(i != at, g + held(i) / count(i))), lambda v: v.isNotNull()))
        value = F.when(count(at) > 1, (outer - inner) / F.greatest(inner, outer, F.lit(1e-300))).otherwise(0.0)
        silhouette = measured.agg(F.avg(value)).first()[0]
    else:
        silhouette = None
    intra = float(np.mean([np.sqrt(2.0 * s / n) for s, n in zip(spreads, sizes)])) if names else None
    between = float(np.linalg.norm(centres[0] - centres[1])) if len(names) == 2 else None
    ratio = between / intra if between is not None and intra else None
    return spark.createDataFrame(
        [(silhouette, intra, between, ratio)], "silhouette DOUBLE, intra_distance DOUBLE, inter_distance DOUBLE, separation_index DOUBLE"
    )


# --- reports -------------------------------------------------------------------


def top_windows(rows: DataFrame, k: int = 10, exclude: Sequence[str] | None = None, others: Sequence[str] = (), score: str = "score", idx: str = "idx", text: str = "text") -> DataFrame:
    """The ``k`` best-scored windows: rank, index, score, band, other scores, text."""
    if exclude:
        rows = rows.filter(excludes_all(text, exclude))
    best = rows.orderBy(F.col(score).desc_nulls_last(), idx).limit(k)
    rank = Window.orderBy(F.col(score).desc_nulls_last(), idx)  # over k rows
    bands = [score_band(o).alias(f"{o}_band") for o in others]
    return best.select(
        F.row_number().over(rank).alias("rank"), idx, score, score_band(score).alias("band"), *others, *bands, text
    )


def assess(metrics: DataFrame, has_features: bool = False, has_times: bool = False, has_texts: bool = False) -> DataFrame:
    """Points, grade, factors and suggestions from one metrics row.

    Needs ``skewness, entropy, anomaly_ratio, cv, lof_score`` (the last may be null).
    """
    skew, entropy, ratio, cv, local = (
        F.col(c) for c in ("skewness", "entropy", "anomaly_ratio", "cv", "lof_score")
    )

    def graded(*steps: tuple[Column | None, int, str | Column, str | None]) -> tuple[Column, Column, Column]:
        points = factor = advice = None
        for condition, value, text, suggestion in steps:
            text = F.lit(text) if isinstance(text, str) else text
            suggestion = F.lit(suggestion).cast("string")
            if condition is None:
                return points.otherwise(value), factor.otherwise(text), advice.otherwise(suggestion)
            points = F.when(condition, value) if points is None else points.when(condition, value)
            factor = F.when(condition, text) if factor is None else factor.when(condition, text)
            advice = F.when(condition, suggestion) if advice is None else advice.when(condition, suggestion)
        return points, factor, advice

    percent = F.format_string("%.2f%%", ratio * 100)
    in_words = [F.format_string(text, percent) for text in fixed.FACTOR_RATIO]
    parts = [
        graded((skew > 1.0, 20, fixed.FACTOR_SKEW[0], None), (skew > 0.5, 15, fixed.FACTOR_SKEW[1], None), (None, 5, fixed.FACTOR_SKEW[2], None)),
        graded((entropy < 2.0, 20, fixed.FACTOR_ENTROPY[0], None), (entropy < 3.0, 10, fixed.FACTOR_ENTROPY[1], None), (None, 0, fixed.FACTOR_ENTROPY[2], None)),
        graded(
            (ratio.between(0.01, 0.05), 20, in_words[0], None),
            (ratio < 0.01, 10, in_words[1], fixed.ADVICE_THRESHOLD_HIGH),
            (ratio <= 0.1, 10, in_words[2], fixed.ADVICE_THRESHOLD_LOW),
            (None, 0, in_words[3], fixed.ADVICE_RATIO),
        ),
        graded((cv > 0.5, 20, fixed.FACTOR_CV[0], None), (cv > 0.3, 10, fixed.FACTOR_CV[1], None), (None, 0, fixed.FACTOR_CV[2], fixed.ADVICE_CV)),
    ]
    lof_points = F.when(local > 1.2, 20).when(local.isNotNull(), 10).otherwise(0)
    lof_factor = F.when(local > 1.2, fixed.FACTOR_LOF[0]).when(local.isNotNull(), fixed.FACTOR_LOF[1])
    total = F.least(parts[0][0] + parts[1][0] + parts[2][0] + parts[3][0] + lof_points, F.lit(100))
    scored = metrics.withColumn("points", total)
    grade = None
    for bound, name in fixed.GRADES:
        grade = F.when(F.col("points") >= bound, name) if grade is None else grade.when(F.col("points") >= bound, name)
    graded_rows = scored.withColumn("grade", grade.otherwise(fixed.GRADE_LOWEST))
    summary = F.element_at(F.create_map(*[F.lit(x) for pair in fixed.GRADE_SUMMARIES.items() for x in pair]), F.col("grade"))
    by_grade = F.when(F.col("grade") == fixed.GRADES[2][1], fixed.ADVICE_FAIR).when(F.col("grade") == fixed.GRADE_LOWEST, fixed.ADVICE_WEAK)
    missing = [
        F.lit(None if given else text).cast("string")
        for given, text in ((has_features, fixed.ADVICE_FEATURES), (has_times, fixed.ADVICE_TIMES), (has_texts, fixed.ADVICE_TEXTS))
    ]
    return graded_rows.withColumns(
        {
            "summary": summary,
            "factors": F.array_compact(F.array(*[p[1] for p in parts], lof_factor)),
            "suggestions": F.array_compact(F.array(*[p[2] for p in parts], by_grade, *missing)),
        }
    )


def report(rows: DataFrame, key: str = "idx", vec: str | None = None, model_name: str = "model", has_times: bool = False, has_texts: bool = False) -> DataFrame:
    """One evaluation row for unlabelled scores: distribution, consistency and assessment."""
    rows = freeze(rows.select(key, "score", *([vec] if vec else [])))
    stats = distribution(rows).first().asDict()
    threshold = stats["percentile_95"]
    counts = exceedance_ratio(rows, threshold).first()
    entropy = histogram_entropy(rows).first()["entropy"]
    local = mean_lof_label(rows, key, vec=vec).first()["lof_score"] if vec else None
    spark = rows.sparkSession
    flat = {
        "model_name": model_name,
        "threshold": threshold,
        "num_anomalies": counts["num_anomalies"],
        "anomaly_ratio": counts["anomaly_ratio"],
        "entropy": entropy,
        "cv": stats["std"] / (stats["mean"] + 1e-10),
        "lof_score": local,
        **{k: v for k, v in stats.items()},
    }
    schema = ", ".join(
        f"{k} {'STRING' if k == 'model_name' else 'BIGINT' if k.startswith('num_') else 'DOUBLE'}" for k in flat
    )
    one = spark.createDataFrame([tuple(flat.values())], schema)
    judged = assess(one, has_features=vec is not None, has_times=has_times, has_texts=has_texts)
    parts = {
        "distribution": [
            "mean", "median", "std", "min", "max", "range", "percentile_95", "percentile_99",
            "skewness", "kurtosis", "iqr", "entropy", "separation_index",
        ],
        "consistency": ["cv", "lof_score"],
        "assessment": ["grade", "points", "summary", "factors"],
    }
    return judged.select(
        "model_name", "num_samples", "threshold", "num_anomalies", "anomaly_ratio", "suggestions",
        *[F.struct(*columns).alias(name) for name, columns in parts.items()],
    )
