"""From log lines to scored windows: fit once on reference vectors, score any number of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.operators import features, fusion, scores, windows
from duskwatch.plans.ordering import freeze


@dataclass
class Detector:
    """Everything the five methods need; all of it bounded by the bank, which ``density`` holds."""

    density: scores.Density
    centres: np.ndarray
    directions: tuple[np.ndarray, np.ndarray]
    forest: DataFrame
    sample: int
    vectorizer: PipelineModel | None = None
    fusion: str = "dynamic_weight"
    options: dict = field(default_factory=dict)


def fit_detector(bank: DataFrame, vectorizer: PipelineModel | None = None, how: str = "dynamic_weight", dims: int = 16, seed: int = 7, **options) -> Detector:
    """Fit every method on ``bank(bank_id, vec)``; needs ten vectors."""
    bank = freeze(bank)
    size = bank.count()
    if size < fixed.BANK_MINIMUM:
        raise ValueError(f"at least {fixed.BANK_MINIMUM} reference vectors are needed")
    return Detector(
        density=scores.fit_density(bank, min(fixed.LOF_NEIGHBOURS, size - 1)),
        centres=scores.fit_clusters(bank, min(fixed.CLUSTERS, size), seed),
        directions=scores.fit_reconstruction(bank, dims),
        forest=freeze(scores.fit_forest(bank, seed=seed)),
        sample=min(fixed.TREE_SAMPLE, size),
        vectorizer=vectorizer,
        fusion=how,
        options=options,
    )


def score(rows: DataFrame, detector: Detector, vec: str = "vec", method: str = "ensemble", threshold: float = 0.5, use_knn: bool = False) -> DataFrame:
    """Add the five method scores, the ensemble, ``score`` and ``is_anomaly``.

    One visit of each vector gives all raw scores; rows stay in the partitions
    they come in unless the bank is beyond the broadcast limit. Scores are scaled
    over the whole run, so they do not depend on batches. Rows need no key.
    """
    raw = freeze(
        scores.all_scores(
            rows, detector.density, detector.centres, detector.directions, detector.forest, detector.sample, vec
        ).withColumns({"reconstruction_error": F.col("reconstruction"), "_knn": F.col("knn")})
    )
    scaled = scores.scale_run(raw, scores.SCORES, flat_is_zero=["contrastive_distance"])
    chosen = fusion.choose_method(fusion.fuse(scaled, detector.fusion, **detector.options), method)
    if use_knn:
        chosen = scores.scale_by_max(chosen, "_knn").withColumn("score", (F.col("score") + F.col("_knn")) / 2)
    return chosen.drop("_knn").withColumn("is_anomaly", F.col("score") > threshold)


def detect_lines(lines: DataFrame, detector: Detector, text: str = "text", **choices) -> DataFrame:
    """Score single lines; ``method_scores`` holds the score of each method."""
    vectors = features.vectorize(lines, detector.vectorizer, text)
    return score(vectors, detector, **choices).withColumn("method_scores", F.struct(*fixed.METHODS))


def detect_sequences(lines: DataFrame, detector: Detector, kind: str = "fixed", size: int = 10, stride: int = 1, **choices) -> DataFrame:
    """Score the windows of ``(seq_id, idx, line)`` sequences, known by ``seq_id`` and ``window_idx``.

    Lines are shuffled once, to form the windows; a window's text is not moved again.
    """
    return detect_lines(windows.make_windows(lines, kind, size, stride, spread=True), detector, **choices).drop("vec")


def fit_on_windows(lines: DataFrame, size: int = 10, dims: int = 256, **choices) -> Detector:
    """Vectorizer, bank and detector from the fixed windows of lines taken as normal."""
    bank, model = features.bank_from_normal_lines(lines, size, dims)
    return fit_detector(bank, model, **choices)


def summarize(scored: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Window count, mean and largest score, mean distances, anomalies and their share; zeros when empty."""

    def value(measure, name):
        return F.coalesce(measure, F.lit(0.0)).alias(name)

    flagged = F.col("is_anomaly")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_windows"),
        value(F.avg("score"), "avg_score"),
        value(F.max("score"), "max_score"),
        value(F.avg("contrastive_distance"), "avg_contrastive_distance"),
        value(F.avg("reconstruction_error"), "avg_reconstruction_error"),
        F.count_if(flagged).alias("num_anomaly_windows"),
        value(F.avg(flagged.cast("double")), "anomaly_ratio"),
    )


def sequence_scores(scored: DataFrame) -> DataFrame:
    """Per sequence the mean and largest score, window count and anomalous window count."""
    return scored.groupBy("seq_id").agg(
        F.avg("score").alias("avg_score"),
        F.max("score").alias("max_score"),
        F.count(F.lit(1)).alias("num_windows"),
        F.count_if("is_anomaly").alias("num_anomaly_windows"),
    )


def anomalous_windows(scored: DataFrame) -> DataFrame:
    """The anomalous windows as rows, however many a sequence has."""
    return scored.filter("is_anomaly").select("seq_id", "window_idx", "score")


def result_json(scored: DataFrame, columns: tuple[str, ...] = ("seq_id", "window_idx", "start_idx", "end_idx", "logs", "score", "is_anomaly", "method_scores")) -> DataFrame:
    """One JSON text per window, for the result file."""
    return scored.select(F.to_json(F.struct(*columns)).alias("value"))
