"""Score evaluation as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.catalog.registry import query, rounded
from duskwatch.catalog.scoring import LOF_CTE, _embeddings
from duskwatch.catalog.views import cte, view
from duskwatch.operators import evaluation as E
from duskwatch.plans.ordering import row_index
from duskwatch.session import new_folder
from duskwatch.sources import sinks as S

_L = cte("scored_labels")
_CURVE = (
    _L
    + ", g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM scored_labels GROUP BY ALL), "
    "c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g) "
)


def _labelled(spark, sf):
    return view(spark, sf, "scored_labels")


@query("roc_curve_points", _CURVE + "SELECT round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(score, 6) AS threshold FROM c")
def _roc(spark, sf):
    return E.roc_points(E.curve(_labelled(spark, sf))).select(*[rounded(c) for c in ("fpr", "tpr", "threshold")])


@query(
    "roc_and_pr_areas",
    _CURVE + "SELECT round(sum(pos * (n - fp + neg / 2)) / max(p * n), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM c",
)
def _areas(spark, sf):
    return E.areas(E.curve(_labelled(spark, sf))).select(rounded("roc_auc"), rounded("pr_auc"))


@query(
    "best_f1_threshold",
    _CURVE + ", f AS (SELECT score, 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-10) AS f1 FROM c) SELECT round(score, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1",
)
def _f1(spark, sf):
    return E.best_f1(E.curve(_labelled(spark, sf))).select(rounded("threshold"), rounded("f1"))


@query("label_summary", _L + "SELECT count(*) AS num_samples, CAST(sum(label) AS BIGINT) AS num_anomalies, round(avg(label), 6) AS anomaly_ratio FROM scored_labels")
def _summary(spark, sf):
    return E.label_summary(_labelled(spark, sf)).select("num_samples", "num_anomalies", rounded("anomaly_ratio"))


@query(
    "evaluation_metrics",
    _CURVE
    + "SELECT 'default' AS model_name, round(sum(pos * (n - fp + neg / 2)) / max(p * n), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc, CAST(max(p + n) AS BIGINT) AS num_samples, CAST(max(p) AS BIGINT) AS num_anomalies, round(max(p / (p + n)), 6) AS anomaly_ratio FROM c",
)
def _metrics(spark, sf):
    one = E.evaluation_metrics(_labelled(spark, sf))
    return one.select("model_name", rounded("roc_auc"), rounded("pr_auc"), "num_samples", "num_anomalies", rounded("anomaly_ratio"))


@query("accuracy_at_threshold", _L + "SELECT round(avg((CAST(score > 0.3 AS INT) = label)::INT), 6) AS accuracy FROM scored_labels")
def _accuracy(spark, sf):
    return E.accuracy(_labelled(spark, sf), 0.3).select(rounded("accuracy"))


_BY_METHOD = (
    _L
    + ", g AS (SELECT method, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored_labels GROUP BY ALL), "
    "c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER v AS p, sum(neg) OVER v AS n FROM g WINDOW w AS (PARTITION BY method ORDER BY score DESC), v AS (PARTITION BY method)), "
    "f AS (SELECT *, 2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-10) AS f1 FROM c), "
    "b AS (SELECT method, score AS t, f1 FROM f QUALIFY row_number() OVER (PARTITION BY method ORDER BY f1 DESC, score) = 1), "
    "a AS (SELECT method, sum(pos * (n - fp + neg / 2)) / max(p * n) AS roc_auc, sum(pos * tp / (tp + fp)) / max(p) AS pr_auc FROM c GROUP BY ALL) "
)


@query(
    "method_evaluation_table",
    _BY_METHOD
    + "SELECT a.method, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(t, 6) AS threshold, round(f1, 6) AS f1, (SELECT round(avg((CAST(s.score > b.t AS INT) = s.label)::INT), 6) FROM scored_labels s WHERE s.method = a.method) AS accuracy FROM a JOIN b ON a.method = b.method",
)
def _table(spark, sf):
    out = E.method_table(_labelled(spark, sf))
    return out.select("method", *[rounded(c) for c in ("roc_auc", "pr_auc", "threshold", "f1", "accuracy")])


@query("methods_ranked_by_area", _BY_METHOD + "SELECT method, CAST(row_number() OVER (ORDER BY roc_auc DESC, method) AS INTEGER) AS place FROM a")
def _ranked(spark, sf):
    from pyspark.sql import Window

    areas = E.areas(E.curve(_labelled(spark, sf), ["method"]), ["method"])
    order = Window.orderBy(F.col("roc_auc").desc(), "method")  # one row per method
    return areas.select("method", F.row_number().over(order).alias("place"))


@query(
    "class_histograms",
    _L
    + """, b AS (SELECT label, min(score) AS lo, max(score) AS hi FROM scored_labels GROUP BY ALL)
    SELECT s.label, CAST(least(floor((score - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS count FROM scored_labels s JOIN b ON s.label = b.label GROUP BY ALL""",
)
def _histograms(spark, sf):
    return E.class_histograms(_labelled(spark, sf)).select("label", "bin", "count")


# --- distribution --------------------------------------------------------------

_S = cte("score_series")
_MOMENTS = """m AS (SELECT avg(score) AS mean, stddev_pop(score) AS std, min(score) AS lo, max(score) AS hi, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.95) AS p95,
    quantile_cont(score, 0.99) AS p99, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM score_series),
    k AS (SELECT avg(power((score - mean) / std, 3)) AS skew, avg(power((score - mean) / std, 4)) - 3 AS kurt FROM score_series, m)"""


def _series(spark, sf):
    return view(spark, sf, "score_series")


@query(
    "score_distribution",
    _S
    + f", {_MOMENTS} SELECT (SELECT count(*) FROM score_series) AS num_samples, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max, round(hi - lo, 6) AS range, round(p95, 6) AS percentile_95, "
    "round(p99, 6) AS percentile_99, round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round((hi - mean) / std, 6) AS separation_index FROM m, k",
)
def _distribution(spark, sf):
    one = E.distribution(_series(spark, sf))
    return one.select("num_samples", *[rounded(c) for c in one.columns if c != "num_samples"])


@query("simple_score_statistics", _S + f", {_MOMENTS} SELECT round(mean, 6) AS mean, round(std, 6) AS std, round(hi, 6) AS max, round(median, 6) AS median, round(p95, 6) AS percentile_95, round(p99, 6) AS percentile_99 FROM m")
def _simple(spark, sf):
    one = E.simple_statistics(_series(spark, sf))
    return one.select(*[rounded(c) for c in one.columns])


_BINS = """bins AS (SELECT least(floor((score - lo) / ((hi - lo) / 30)), 29) AS bin, count(*) / (SELECT count(*) FROM score_series) AS p FROM score_series, (SELECT min(score) AS lo, max(score) AS hi FROM score_series) GROUP BY bin)"""


@query("histogram_entropy", _S + f", {_BINS} SELECT round(-sum(p * log2(p + 1e-10)), 6) AS entropy FROM bins")
def _entropy(spark, sf):
    return E.histogram_entropy(_series(spark, sf)).select(rounded("entropy"))


@query(
    "kde_entropy",
    _S
    + """, b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n FROM score_series), x AS (SELECT (score - lo) / (hi - lo) AS x FROM score_series, b),
    h AS (SELECT var_samp(x) * power(count(*), -0.4) AS v FROM x), d AS (SELECT g, sum(exp(-(x - g / 99.0::DOUBLE) * (x - g / 99.0::DOUBLE) / (2 * v))) AS d FROM x, h, (SELECT unnest(range(100)) AS g) GROUP BY g),
    p AS (SELECT d / (SELECT sum(d) FROM d) AS p FROM d)
    SELECT round(-sum(p * log2(p + 1e-10)), 6) AS score_entropy, round(-sum(p * log2(p + 1e-10)) / log2(100), 6) AS normalized_entropy FROM p""",
)
def _kde(spark, sf):
    return E.kde_entropy(_series(spark, sf)).select(rounded("score_entropy"), rounded("normalized_entropy"))


_QUALITY = "CASE WHEN skew > 1 AND sep > 2 THEN 'good' WHEN skew > 0.5 AND sep > 1.5 THEN 'acceptable' WHEN skew <= 0.5 OR sep <= 1 THEN 'poor' ELSE 'moderate' END"


@query(
    "score_consistency",
    _S
    + f""", {_MOMENTS}, o AS (SELECT *, (hi - mean) / (std + 1e-10) AS sep FROM m, k)
    SELECT round(sep, 6) AS separation_index, round((q3 - q1) / (hi - lo + 1e-10), 6) AS iqr_range_ratio, round((SELECT avg((score > mean + 2 * std)::INT) FROM score_series), 6) AS high_score_density,
    round((SELECT avg((score > p99)::INT) FROM score_series), 6) AS very_high_score_density, round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis, {_QUALITY} AS distribution_quality FROM o""",
)
def _consistency(spark, sf):
    one = E.consistency(_series(spark, sf))
    return one.select(*[c if c == "distribution_quality" else rounded(c) for c in one.columns])


@query(
    "method_score_statistics",
    _S
    + f""", m AS (SELECT method, avg(score) AS mean, stddev_pop(score) AS std, max(score) AS hi FROM score_series GROUP BY ALL),
    k AS (SELECT m.method, mean, std, hi, avg(power((score - mean) / std, 3)) AS skew, (hi - mean) / (std + 1e-10) AS sep FROM score_series s JOIN m ON s.method = m.method GROUP BY ALL)
    SELECT method, round(mean, 6) AS mean, round(std, 6) AS std, round(hi, 6) AS max, round(sep, 6) AS separation_index, {_QUALITY} AS distribution_quality FROM k""",
)
def _methods(spark, sf):
    return E.method_statistics(_series(spark, sf)).select("method", *[rounded(c) for c in ("mean", "std", "max", "separation_index")], "distribution_quality")


for _method, _expression in {"percentile": "p95", "std": "mean + 2 * std", "iqr": "q3 + 1.5 * (q3 - q1)"}.items():

    @query(f"threshold_by_{_method}", _S + f", {_MOMENTS} SELECT round({_expression}, 6) AS threshold FROM m")
    def _threshold(spark, sf, method=_method):
        return E.suggest_threshold(_series(spark, sf), method).select(rounded("threshold"))


@query(
    "anomalies_at_95th_percentile",
    _S + f", {_MOMENTS} SELECT count(*) FILTER (score >= p95) AS num_anomalies, round(count(*) FILTER (score >= p95) / count(*), 6) AS anomaly_ratio FROM score_series, m",
)
def _at95(spark, sf):
    series = _series(spark, sf)
    threshold = E.suggest_threshold(series).first()[0]
    return E.exceedance_ratio(series, threshold).select("num_anomalies", rounded("anomaly_ratio"))


@query("threshold_exceedances", _S + "SELECT idx, round(score, 6) AS score FROM score_series WHERE score >= 0.5")
def _exceed(spark, sf):
    return E.exceedances(_series(spark, sf), 0.5).select("idx", rounded("score"))


@query(
    "unsupervised_summary",
    _S + "SELECT 0.25::DOUBLE AS threshold, count(*) AS num_samples, count(*) FILTER (score > 0.25) AS num_anomalies, round(avg((score > 0.25)::INT), 6) AS anomaly_ratio FROM score_series",
)
def _unsupervised(spark, sf):
    return E.unsupervised_summary(_series(spark, sf), 0.25).select("threshold", "num_samples", "num_anomalies", rounded("anomaly_ratio"))


@query("coefficient_of_variation", _S + "SELECT round(stddev_pop(score) / (avg(score) + 1e-10), 6) AS cv FROM score_series")
def _cv(spark, sf):
    return _series(spark, sf).agg(rounded(F.stddev_pop("score") / (F.avg("score") + F.lit(1e-10)), "cv"))


# --- trend ---------------------------------------------------------------------


@query("score_trend", _S + "SELECT round(regr_slope(score, idx), 12) + 0.0 AS trend_slope, round(regr_intercept(score, idx), 6) AS trend_intercept FROM score_series")
def _trend(spark, sf):
    return E.trend(_series(spark, sf)).select(rounded("trend_slope", digits=12), rounded("trend_intercept"))


_ACF = (
    _S
    + """, x AS (SELECT idx, score - (SELECT avg(score) FROM score_series) AS x FROM score_series), l AS (SELECT unnest(range(1, 41)) AS lag),
    r AS (SELECT lag, sum(a.x * b.x) / (SELECT sum(x * x) FROM x) AS r FROM l, x a JOIN x b ON b.idx = a.idx + l.lag GROUP BY lag),
    v AS (SELECT *, 1.96 * sqrt((1 + 2 * coalesce(sum(r * r) OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (SELECT count(*) FROM x)) AS bound FROM r)"""
)


@query("score_autocorrelation", _ACF + "SELECT CAST(lag AS INTEGER) AS lag, round(r, 6) + 0.0 AS r, round(bound, 6) AS bound, abs(r) > bound AS significant FROM v")
def _acf(spark, sf):
    return E.autocorrelation(_series(spark, sf), block=1000).select("lag", rounded("r"), rounded("bound"), "significant")


@query(
    "score_periodicity",
    _ACF + "SELECT count(*) FILTER (abs(r) > bound) > 0 AS has_periodicity, CAST(arg_max(lag, abs(r)) FILTER (abs(r) > bound) AS INTEGER) AS strongest_lag, round(arg_max(r, abs(r)) FILTER (abs(r) > bound), 6) AS strongest_value FROM v",
)
def _periodicity(spark, sf):
    out = E.periodicity(E.autocorrelation(_series(spark, sf), block=1000))
    return out.select("has_periodicity", "strongest_lag", rounded("strongest_value"))


@query(
    "chronological_split",
    """WITH i AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_id FROM events), n AS (SELECT count(*) AS n FROM i)
    SELECT CASE WHEN idx >= n - CAST(floor(n * 0.2) AS BIGINT) THEN 'eval' ELSE 'train' END AS part, count(*) AS lines, min(idx) AS first, max(idx) AS last FROM i, n GROUP BY ALL""",
)
def _split(spark, sf):
    from duskwatch.catalog.views import table

    lines = row_index(table(spark, sf, "events").select("ts", "event_id"), ["ts", "event_id"])
    train, held = E.chronological_split(lines)
    both = train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("eval")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("lines"), F.min("idx").alias("first"), F.max("idx").alias("last"))


# --- features ------------------------------------------------------------------


def _scored_vectors(spark, sf):
    return _embeddings(spark, sf).withColumn("score", F.col("label") / 10.0 + F.get("vec", F.lit(0)).cast("double"))


_SCORED_LOF = (
    LOF_CTE
    + """, s AS (SELECT l.vec_id, lof, e.label / 10.0::DOUBLE + CAST(e.embedding[1] AS DOUBLE) AS score FROM lof l JOIN embeddings e ON l.vec_id = e.vec_id),
    t AS (SELECT quantile_cont(lof, 0.9) AS lt, quantile_cont(score, 0.9) AS st FROM s), y AS (SELECT vec_id, score, CASE WHEN lof > lt THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS l, score > st AS h FROM s, t)"""
)


@query(
    "lof_score_agreement",
    _SCORED_LOF
    + " SELECT round(corr(l, score), 6) + 0.0 AS lof_correlation, round(avg(l) FILTER (h), 6) AS high_score_mean, round(avg(l) FILTER (NOT h), 6) AS rest_mean, round(avg(l) FILTER (h) / (avg(l) FILTER (NOT h) + 1e-10), 6) AS high_score_lof_ratio FROM y",
)
def _agreement(spark, sf):
    one = E.lof_agreement(_scored_vectors(spark, sf), "vec_id")
    return one.select(*[rounded(c) for c in one.columns])


@query(
    "spatial_density_agreement",
    _SCORED_LOF
    + """, r AS (SELECT *, row_number() OVER (ORDER BY score, vec_id) - 1 >= CAST(floor((SELECT count(*) FROM s) * 0.9) AS BIGINT) AS top FROM y)
    SELECT round(corr(l, score), 6) + 0.0 AS lof_correlation, round(avg(l) FILTER (top), 6) AS top10pct_density, round(avg(l) FILTER (NOT top), 6) AS rest_density, round(avg(l) FILTER (top) / (avg(l) FILTER (NOT top) + 1e-10), 6) AS density_ratio FROM r""",
)
def _density(spark, sf):
    one = E.spatial_density(_scored_vectors(spark, sf), "vec_id")
    return one.select(*[rounded(c) for c in one.columns])


@query("mean_lof_label", LOF_CTE + " SELECT round(avg(CASE WHEN lof > 1.5 THEN 1.0 ELSE -1.0 END), 6) AS lof_score, round(avg(lof), 6) AS mean_lof FROM lof")
def _lof_label(spark, sf):
    one = E.mean_lof_label(_embeddings(spark, sf), "vec_id")
    return one.select(rounded("lof_score"), rounded("mean_lof"))


@query(
    "class_separation",
    """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, CASE WHEN label < 5 THEN 0 ELSE 1 END AS k FROM embeddings),
    d AS (SELECT x.vec_id, x.k, y.k AS ok, sum(power(list_distance(x.a, y.a), 2)) AS s, count(*) AS n FROM q x, q y GROUP BY ALL),
    i AS (SELECT vec_id, k, max(CASE WHEN k = ok THEN s / (n - 1) END) AS inner_d, min(CASE WHEN k <> ok THEN s / n END) AS outer_d, max(CASE WHEN k = ok THEN s / n END) AS within FROM d GROUP BY ALL),
    c AS (SELECT k, i, avg(a[i]) AS m FROM q, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
    t AS (SELECT sqrt(sum(power(x.m - y.m, 2))) AS inter FROM c x JOIN c y ON x.i = y.i AND x.k = 0 AND y.k = 1), w AS (SELECT avg(sqrt(within)) AS intra FROM (SELECT k, avg(within) AS within FROM i GROUP BY ALL))
    SELECT (SELECT round(avg((outer_d - inner_d) / greatest(outer_d, inner_d)), 5) + 0.0 FROM i) AS silhouette, round(intra, 5) AS intra_distance, round(inter, 5) AS inter_distance, round(inter / intra, 5) AS separation_index FROM t, w""",
)
def _separation(spark, sf):
    rows = _embeddings(spark, sf).withColumn("label", F.when(F.col("label") < 5, 0).otherwise(1))
    one = E.class_separation(rows, "vec_id")
    return one.select(*[rounded(c, digits=5) for c in one.columns])


# --- reports -------------------------------------------------------------------


@query(
    "top_scored_windows",
    _L
    + """, f AS (SELECT doc_id AS idx, score, text FROM scored_labels WHERE NOT contains(lower(text), 'lorem') AND NOT contains(lower(text), 'http'))
    SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INTEGER) AS rank, idx, round(score, 6) AS score, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS band, md5(text) AS text FROM f ORDER BY f.score DESC, idx LIMIT 10""",
)
def _top(spark, sf):
    rows = _labelled(spark, sf).withColumnRenamed("doc_id", "idx")
    best = E.top_windows(rows, 10, ["Lorem", "HTTP"])
    return best.select("rank", "idx", rounded("score"), "band", F.md5("text").alias("text"))


@query("windows_sorted_by_score", _S + "SELECT idx, round(score, 6) AS score FROM score_series")
def _sorted(spark, sf):
    from duskwatch.operators.records import resort

    return resort(_series(spark, sf)).select("idx", rounded("score"))


_ASSESS = (
    _S
    + f""", {_MOMENTS}, {_BINS}, e AS (SELECT -sum(p * log2(p + 1e-10)) AS entropy FROM bins), r AS (SELECT count(*) FILTER (score >= p95) / count(*) AS ratio FROM score_series, m),
    pts AS (SELECT CASE WHEN skew > 1 THEN 20 WHEN skew > 0.5 THEN 15 ELSE 5 END + CASE WHEN entropy < 2 THEN 20 WHEN entropy < 3 THEN 10 ELSE 0 END
      + CASE WHEN ratio BETWEEN 0.01 AND 0.05 THEN 20 WHEN ratio < 0.01 THEN 10 WHEN ratio <= 0.1 THEN 10 ELSE 0 END + CASE WHEN std / (mean + 1e-10) > 0.5 THEN 20 WHEN std / (mean + 1e-10) > 0.3 THEN 10 ELSE 0 END AS points FROM m, k, e, r)"""
)


@query(
    "evaluation_assessment",
    _ASSESS + "SELECT CAST(points AS INTEGER) AS points, CASE WHEN points >= 80 THEN '优秀' WHEN points >= 60 THEN '良好' WHEN points >= 40 THEN '一般' ELSE '不佳' END AS grade FROM pts",
)
def _assessment(spark, sf):
    return E.report(_series(spark, sf)).select("assessment.points", "assessment.grade")


@query("evaluation_report_entries")
def _entries(spark, sf):
    """The report written as JSON, read back, and laid out as key and value rows."""
    folder = new_folder(spark, "report")
    whole = E.report(_series(spark, sf), model_name="series")
    S.write_json(whole, folder)
    return S.key_values(spark.read.schema(whole.schema).json(folder))


@query("prediction_records", _L + "SELECT doc_id AS id, label AS true_label, CAST(score > 0.3 AS INTEGER) AS predicted_label, CAST(score > 0.3 AS INTEGER) = label AS correct FROM scored_labels")
def _predictions(spark, sf):
    """Prediction records written as JSON lines and read back."""
    folder = new_folder(spark, "predictions")
    records = S.prediction_rows(_labelled(spark, sf).withColumnRenamed("doc_id", "id"), 0.3)
    S.write_json(records, folder)
    return spark.read.schema(records.schema).json(folder).select("id", "true_label", "predicted_label", "correct")


@query("split_files", "SELECT 'eval' AS part, CAST(floor(count(*) * 0.2) AS BIGINT) AS lines FROM events UNION ALL SELECT 'train', count(*) - CAST(floor(count(*) * 0.2) AS BIGINT) FROM events")
def _files(spark, sf):
    folder = new_folder(spark, "split")
    lines = row_index(view(spark, sf, "logs").select("timestamp", "log_id", "message"), ["timestamp", "log_id"])
    train, held = E.chronological_split(lines)
    S.write_lines(train, "message", f"{folder}/train")
    S.write_lines(held, "message", f"{folder}/eval")
    parts = [spark.read.text(f"{folder}/{p}").select(F.lit(p).alias("part")) for p in ("train", "eval")]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count(F.lit(1)).alias("lines"))


@query("saved_bank_and_stats", "SELECT count(*) AS vectors, 5::BIGINT AS methods FROM embeddings")
def _saved(spark, sf):
    from duskwatch.catalog.scoring import _bank
    from duskwatch.operators import features, scores

    folder = new_folder(spark, "bank")
    features.save_bank(_bank(spark, sf), scores.score_stats(_series(spark, sf)), folder)
    bank, stats = features.load_bank(spark, folder)
    return bank.agg(F.count(F.lit(1)).alias("vectors")).withColumn("methods", F.lit(stats.count()).cast("long"))


@query("anomaly_table_rows_per_day", cte("web_logs") + "SELECT 'sql_injection' AS anomaly_type, count(*) AS count FROM web_logs WHERE path ILIKE '%UNION%SELECT%' OR path ILIKE '%1=1%' OR path ILIKE '%DROP%TABLE%'")
def _appended(spark, sf):
    """Detector output appended to a table partitioned by day and read back."""
    from duskwatch.operators import rules as R

    folder = new_folder(spark, "web-anomalies")
    S.append_anomalies(R.flag_rows(view(spark, sf, "web_logs"), R.WEB_SQL_INJECTION), "web", folder)
    return spark.read.parquet(folder).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))


@query("log_table_rows_per_day", cte("ssh_logs") + "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS count FROM ssh_logs GROUP BY ALL")
def _log_table(spark, sf):
    """Typed logs appended to a table partitioned by day and read back."""
    folder = new_folder(spark, "ssh-logs")
    S.append_logs(view(spark, sf, "ssh_logs"), "ssh", folder)
    return spark.read.parquet(folder).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("count"))


@query("exported_query_results", cte("anomalies") + "SELECT anomaly_type AS type, count(*) AS count FROM anomalies GROUP BY ALL")
def _export(spark, sf):
    from duskwatch.operators.records import per_type

    folder = new_folder(spark, "export")
    S.write_csv(per_type(view(spark, sf, "anomalies")), folder)
    return spark.read.option("header", True).schema("type STRING, count BIGINT").csv(folder)
