"""Windows, features, outlier scores and fusion as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.catalog.registry import query, rounded
from duskwatch.catalog.views import cte, table, view
from duskwatch.functions import fixed_values as fixed
from duskwatch.functions import vectors as V
from duskwatch.operators import features, fusion, scores, windows
from duskwatch.operators.neighbours import nearest
from duskwatch.plans import scoring
from duskwatch.plans.ordering import freeze

_INDEXED = (
    cte("sequences")
    + ", lines AS (SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, ts, line FROM sequences)"
)


def _lines(spark, sf):
    return windows.with_index(view(spark, sf, "sequences"), ["ts", "event_id"]).select("seq_id", "idx", "ts", "line")


@query(
    "fixed_line_windows",
    _INDEXED
    + """ SELECT seq_id, idx // 5 AS window_idx, min(idx) AS start_idx, max(idx) + 1 AS end_idx, string_agg(line, ' [SEP] ' ORDER BY idx) AS text FROM lines GROUP BY ALL""",
)
def _fixed(spark, sf):
    return windows.fixed_windows(_lines(spark, sf), 5).drop("logs")


@query(
    "sliding_line_windows",
    _INDEXED
    + """ SELECT a.seq_id, a.idx // 3 AS window_idx, a.idx AS start_idx, a.idx + 5 AS end_idx, string_agg(b.line, ' [SEP] ' ORDER BY b.idx) AS text
    FROM lines a JOIN lines b ON a.seq_id = b.seq_id AND b.idx BETWEEN a.idx AND a.idx + 4 WHERE a.idx % 3 = 0 GROUP BY ALL HAVING count(*) = 5""",
)
def _sliding(spark, sf):
    return windows.sliding_windows(_lines(spark, sf), 5, 3).drop("logs")


@query(
    "single_line_windows",
    _INDEXED
    + """, n AS (SELECT seq_id, count(*) AS n FROM lines GROUP BY ALL)
    SELECT seq_id, sum(CASE WHEN n = 1 THEN 1 WHEN idx + 70 <= n THEN 1 ELSE 0 END)::BIGINT AS windows FROM lines JOIN n USING (seq_id) GROUP BY ALL
    HAVING sum(CASE WHEN n = 1 THEN 1 WHEN idx + 70 <= n THEN 1 ELSE 0 END) > 0""",
)
def _single(spark, sf):
    cut = windows.sliding_windows(_lines(spark, sf), 70, 1, keep_single=True)
    return cut.groupBy("seq_id").agg(F.count(F.lit(1)).alias("windows"))


@query(
    "window_member_lines",
    _INDEXED + " SELECT seq_id, idx // 7 AS window_idx, idx, line FROM lines",
)
def _members(spark, sf):
    return windows.window_members(windows.fixed_windows(_lines(spark, sf), 7))


@query(
    "time_windows_of_events",
    """SELECT time_bucket(INTERVAL 6 HOUR, ts - to_hours(CAST(k * 6 AS INTEGER)), TIMESTAMP '1970-01-01') + INTERVAL 0 HOUR AS window_start,
      time_bucket(INTERVAL 6 HOUR, ts - to_hours(CAST(k * 6 AS INTEGER)), TIMESTAMP '1970-01-01') + INTERVAL 12 HOUR AS window_end,
      count(*) AS lines, min(ts) AS first, max(ts) AS last FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""",
)
def _timed(spark, sf):
    return windows.time_windows(table(spark, sf, "events"), "ts", "12 hours", "6 hours")


@query(
    "event_bounded_windows",
    _INDEXED
    + """, m AS (SELECT seq_id, idx, line, last_value(CASE WHEN line LIKE 'signup%' THEN idx END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS start_idx FROM lines)
    SELECT seq_id, start_idx, idx AS end_idx, idx - start_idx + 1 AS lines FROM m WHERE line LIKE 'error%' AND start_idx IS NOT NULL""",
)
def _bounded(spark, sf):
    text = F.col("line")
    return windows.bounded_windows(_lines(spark, sf), text.startswith("signup"), text.startswith("error"))


@query(
    "moving_average_of_scores",
    cte("score_series")
    + """SELECT idx, round(avg, 6) AS moving_avg FROM (SELECT idx, avg(score) OVER (ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg FROM score_series) WHERE idx >= 19""",
)
def _moving(spark, sf):
    return windows.moving_average(view(spark, sf, "score_series").select("idx", "score"), block=1000).select("idx", rounded("moving_avg"))


@query(
    "adaptive_thresholds",
    cte("score_series")
    + """, t AS (SELECT idx, score, CASE WHEN count(*) OVER w >= 50 THEN least(0.95::DOUBLE, avg(score) OVER w + 2 * stddev_samp(score) OVER w) ELSE 0.7::DOUBLE END AS t FROM score_series
      WINDOW w AS (ORDER BY idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT idx, round(t, 6) AS threshold, score > t AS above FROM t""",
)
def _adaptive(spark, sf):
    out = windows.adaptive_threshold(view(spark, sf, "score_series").select("idx", "score"), block=1000)
    return out.select("idx", rounded("threshold"), (F.col("score") > F.col("threshold")).alias("above"))


# --- features -----------------------------------------------------------------

_WORDS = r"""list_filter(string_split_regex(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(message, '\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}.\d{3}', '', 'g'),
    '\b(INFO|DEBUG|ERROR|WARNING|WARN|TRACE)\b', '', 'g'), '\s+', ' ', 'g')), '[^a-zA-Z0-9\s]', '', 'g')), '\s+'), lambda t: t <> '')"""
_VOCABULARY = f"""vocabulary AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) AS BIGINT) AS token_id FROM
    (SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS}) AS token FROM logs) GROUP BY ALL))"""


@query("word_vocabulary", cte("logs") + f", {_VOCABULARY} SELECT * FROM vocabulary")
def _vocabulary(spark, sf):
    return features.build_vocabulary(view(spark, sf, "logs"), "message", None)


_CODED = f""", {_VOCABULARY}, w AS (SELECT log_id, unnest({_WORDS}) AS token, generate_subscripts({_WORDS}, 1) AS place FROM logs),
    i AS (SELECT log_id, place, token_id AS id FROM w JOIN vocabulary v ON w.token = v.token)"""


@query("token_id_lists", cte("logs") + _CODED + " SELECT log_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) AS ids FROM i GROUP BY ALL")
def _ids(spark, sf):
    """Every word of every message."""
    logs = view(spark, sf, "logs")
    vocabulary = features.build_vocabulary(logs, "message", None)
    return features.token_ids(logs, vocabulary, "log_id", "message", None).select("log_id", F.array_join("ids", ",").alias("ids"))


@query(
    "padded_token_id_lists",
    cte("logs") + _CODED + " SELECT log_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) || repeat(',0', CAST(128 - count(*) AS INTEGER)) AS ids FROM i GROUP BY ALL",
)
def _padded(spark, sf):
    """The lists as a model takes them: 128 ids, the vocabulary of 30,522 words."""
    logs = view(spark, sf, "logs")
    vocabulary = features.build_vocabulary(logs, "message")
    return features.token_ids(logs, vocabulary, "log_id", "message").select("log_id", F.array_join("ids", ",").alias("ids"))


@query("message_vectors")
def _vectors(spark, sf):
    logs = view(spark, sf, "logs").select("log_id", "message")
    model = features.fit_vectorizer(logs, "message", 64)
    return features.vectorize(logs, model, "message").select("log_id", F.size("vec").alias("dims"), rounded(V.dot("vec", "vec"), "norm"))


@query("tfidf_terms")
def _tfidf(spark, sf):
    from pyspark.ml.functions import vector_to_array

    logs = view(spark, sf, "logs").select("log_id", "message")
    model = features.tfidf_ngrams(logs, "message")
    found = features.apply_tfidf(logs, model, "message")
    return found.select("log_id", F.size(F.filter(vector_to_array("tfidf"), lambda x: x > 0)).alias("terms"))


@query("augmented_messages")
def _augmented(spark, sf):
    return features.augment(view(spark, sf, "logs").select("log_id", "message"), "log_id", "message")


@query("half_sample_marks", "SELECT (count(*) // 2) AS chosen, count(*) - count(*) // 2 AS rest FROM events")
def _half(spark, sf):
    marked = features.mark_sample(table(spark, sf, "events").select("event_id"), "event_id")
    return marked.agg(F.count_if("chosen").alias("chosen"), F.count_if(~F.col("chosen")).alias("rest"))


def _bank(spark, sf):
    return freeze(features.build_bank(table(spark, sf, "embeddings"), "vec_id", "embedding"))


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


@query("bank_of_vectors", "SELECT vec_id AS bank_id FROM embeddings")
def _bank_rows(spark, sf):
    return _bank(spark, sf).select("bank_id")


@query("bank_from_normal_windows")
def _bank_windows(spark, sf):
    normal = _lines(spark, sf).filter(~F.col("line").startswith("error"))
    bank, _ = features.bank_from_normal_lines(windows.with_index(normal.drop("idx"), ["ts", "line"]), 5, 64)
    return bank.select("bank_id", F.size("vec").alias("dims"))


# --- scores -------------------------------------------------------------------

_PAIRS = (
    "WITH bank AS (SELECT vec_id AS bank_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings), "
    "q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), "
    "d AS (SELECT vec_id, bank_id, list_distance(a, b) AS distance FROM q, bank), "
    "near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, bank_id) AS rank FROM d)"
)


@query("nearest_bank_vectors", _PAIRS + " SELECT vec_id, CAST(rank AS INTEGER) AS rank, bank_id, round(distance, 6) AS distance FROM near WHERE rank <= 3")
def _nearest(spark, sf):
    found = nearest(_embeddings(spark, sf), _bank(spark, sf), 3, "vec_id")
    return found.select("vec_id", F.posexplode("neighbours").alias("_p", "_n")).select(
        "vec_id", (F.col("_p") + 1).alias("rank"), "_n.bank_id", rounded("_n.distance", "distance")
    )


@query("knn_scores", _PAIRS + " SELECT vec_id, round(avg(distance), 6) AS knn FROM near WHERE rank <= 5 GROUP BY ALL")
def _knn(spark, sf):
    return scores.knn_score(_embeddings(spark, sf), _bank(spark, sf), "vec_id").select("vec_id", rounded("knn"))


@query("knn_scores_by_blocks", _PAIRS + " SELECT vec_id, round(avg(distance), 6) AS knn FROM near WHERE rank <= 5 GROUP BY ALL")
def _knn_blocks(spark, sf):
    """The route for banks beyond the broadcast limit, on the same vectors."""
    rows = _embeddings(spark, sf)
    bank = rows.select(F.col("vec_id").alias("bank_id"), "vec")
    return scores.knn_score(rows, bank, "vec_id", limit=200).select("vec_id", rounded("knn"))


@query(
    "knn_scores_scaled",
    _PAIRS + ", s AS (SELECT vec_id, avg(distance) AS s FROM near WHERE rank <= 5 GROUP BY ALL) SELECT vec_id, round((s - (SELECT min(s) FROM s)) / ((SELECT max(s) FROM s) - (SELECT min(s) FROM s)), 6) AS knn FROM s",
)
def _knn_scaled(spark, sf):
    scored = freeze(scores.knn_score(_embeddings(spark, sf), _bank(spark, sf), "vec_id"))
    return scores.scale_run(scored, ["knn"]).select("vec_id", rounded("knn"))


@query(
    "knn_enhanced_scores",
    _PAIRS + ", s AS (SELECT vec_id, avg(distance) AS s FROM near WHERE rank <= 5 GROUP BY ALL) SELECT s.vec_id, round((label / 10.0::DOUBLE + s / ((SELECT max(s) FROM s) + 1e-10)) / 2, 6) AS score FROM s JOIN embeddings e ON s.vec_id = e.vec_id",
)
def _enhanced(spark, sf):
    rows = _embeddings(spark, sf).withColumn("score", F.col("label") / 10.0)
    return fusion.knn_enhanced(rows, _bank(spark, sf), "vec_id").select("vec_id", rounded("score"))


_LOF = """, e AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, bank_id) AS r FROM d WHERE vec_id <> bank_id),
    k AS (SELECT vec_id, bank_id, distance FROM e WHERE r <= 20), kd AS (SELECT vec_id, max(distance) AS kd FROM k GROUP BY ALL),
    lrd AS (SELECT k.vec_id, 1 / (avg(greatest(k.distance, kd.kd)) + 1e-10) AS lrd FROM k JOIN kd ON k.bank_id = kd.vec_id GROUP BY ALL),
    lof AS (SELECT k.vec_id, avg(o.lrd) / any_value(m.lrd) AS lof FROM k JOIN lrd o ON k.bank_id = o.vec_id JOIN lrd m ON k.vec_id = m.vec_id GROUP BY ALL)"""
LOF_CTE = _PAIRS + _LOF


@query("local_outlier_factors", LOF_CTE + " SELECT vec_id, round(lof, 6) AS lof FROM lof")
def _lof(spark, sf):
    return scores.lof(_embeddings(spark, sf), "vec_id").select("vec_id", rounded("lof"))


@query(
    "lof_novelty_scores",
    LOF_CTE
    + """, nk AS (SELECT * FROM near WHERE rank <= 20), nl AS (SELECT nk.vec_id, 1 / (avg(greatest(nk.distance, kd.kd)) + 1e-10) AS lrd FROM nk JOIN kd ON nk.bank_id = kd.vec_id GROUP BY ALL)
    SELECT nk.vec_id, round(avg(lrd.lrd) / any_value(nl.lrd) - 1.5, 6) AS lof FROM nk JOIN lrd ON nk.bank_id = lrd.vec_id JOIN nl ON nk.vec_id = nl.vec_id GROUP BY ALL""",
)
def _novelty(spark, sf):
    return scores.lof_novelty(_embeddings(spark, sf), _bank(spark, sf), "vec_id").select("vec_id", rounded("lof"))


@query(
    "contrastive_distances",
    """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), queue AS (SELECT vec_id AS bank_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings ORDER BY vec_id DESC LIMIT 4096),
    m AS (SELECT vec_id, min(list_cosine_distance(a, b)) AS d FROM q, queue WHERE vec_id <> -1 GROUP BY ALL)
    SELECT vec_id, CASE WHEN abs(d) < 1e-9 THEN 0.0::DOUBLE ELSE round(d, 6) END AS raw FROM m""",
)
def _contrastive(spark, sf):
    rows = _embeddings(spark, sf)
    found = nearest(rows, scores.recent_queue(rows, "vec_id", fixed.QUEUE_LIMIT), 1, "vec_id", metric="cosine")
    return found.select("vec_id", rounded(F.get("neighbours", F.lit(0))["distance"], "raw"))


@query(
    "contrastive_distances_scaled",
    """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), queue AS (SELECT CAST(embedding AS DOUBLE[]) AS b FROM embeddings WHERE label = 0 ORDER BY vec_id DESC LIMIT 4096),
    m AS (SELECT vec_id, min(list_cosine_distance(a, b)) AS d FROM q, queue GROUP BY ALL)
    SELECT vec_id, abs(round((d - (SELECT min(d) FROM m)) / ((SELECT max(d) FROM m) - (SELECT min(d) FROM m)), 6)) AS contrastive_distance FROM m""",
)
def _contrastive_scaled(spark, sf):
    rows = _embeddings(spark, sf)
    queue = scores.recent_queue(rows.filter("label = 0"), "vec_id", fixed.QUEUE_LIMIT)
    return scores.contrastive_distance(rows, queue, "vec_id").select("vec_id", rounded("contrastive_distance"))


@query("unfitted_bank_scores", "SELECT vec_id, 0.0::DOUBLE AS knn FROM embeddings")
def _unfitted(spark, sf):
    rows = _embeddings(spark, sf)
    bank = rows.orderBy("vec_id").limit(fixed.BANK_MINIMUM - 1).select(F.col("vec_id").alias("bank_id"), "vec")
    return scores.knn_score(rows, bank, "vec_id").select("vec_id", "knn")


@query("cluster_scores")
def _cluster(spark, sf):
    return scores.cluster_score(_embeddings(spark, sf), scores.fit_clusters(_bank(spark, sf))).select("vec_id", "cluster")


@query("reconstruction_errors")
def _reconstruction(spark, sf):
    return scores.reconstruction_score(_embeddings(spark, sf), scores.fit_reconstruction(_bank(spark, sf))).select("vec_id", "reconstruction")


@query("isolation_forest_scores")
def _forest(spark, sf):
    bank = _bank(spark, sf)
    return scores.forest_score(_embeddings(spark, sf), scores.fit_forest(bank), min(fixed.TREE_SAMPLE, bank.count())).select("vec_id", "iforest")


@query(
    "vector_expressions",
    """SELECT vec_id, round(sqrt(list_inner_product(a, a)), 6) AS norm, round(list_distance(a, b), 6) AS euclid, round(list_cosine_distance(a, b), 6) AS cosine
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x + 0.5) AS b FROM embeddings)""",
)
def _expressions(spark, sf):
    rows = _embeddings(spark, sf).withColumn("b", F.transform("vec", lambda x: x.cast("double") * x.cast("double") + 0.5))
    return rows.select(
        "vec_id",
        rounded(F.sqrt(V.dot("vec", "vec")), "norm"),
        rounded(V.euclidean("vec", "b"), "euclid"),
        rounded(V.cosine_distance("vec", "b"), "cosine"),
    )


# --- scaling and statistics ---------------------------------------------------

_SCALED = cte("score_series")


@query(
    "scores_scaled_per_method",
    _SCALED + "SELECT idx, method, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) AS score FROM score_series WINDOW w AS (PARTITION BY method)",
)
def _scaled(spark, sf):
    return scores.scale_methods(view(spark, sf, "score_series").select("idx", "method", "score")).select("idx", "method", rounded("score"))


@query(
    "scores_scaled_by_stored_stats",
    _SCALED + "SELECT idx, method, round(greatest(0, least(1, (score - 0.05) / 0.3)), 6) AS score FROM score_series",
)
def _stored(spark, sf):
    series = view(spark, sf, "score_series").select("idx", "method", "score")
    stats = spark.createDataFrame([(m, 0.05, 0.35) for m in fixed.METHODS], "method STRING, min DOUBLE, max DOUBLE")
    return scores.scale_by_stats(series, stats).select("idx", "method", rounded("score"))


@query("scores_scaled_by_max", _SCALED + "SELECT idx, round(score / ((SELECT max(score) FROM score_series) + 1e-10), 6) AS score FROM score_series")
def _by_max(spark, sf):
    return scores.scale_by_max(view(spark, sf, "score_series").select("idx", "score"), "score").select("idx", rounded("score"))


@query(
    "running_score_stats",
    _SCALED + "SELECT method, round(min(score), 6) AS min, round(max(score), 6) AS max, round(sum(score), 6) AS sum, count(*) AS count FROM score_series GROUP BY ALL",
)
def _stats(spark, sf):
    series = view(spark, sf, "score_series")
    half = F.col("ts") < "2024-01-15"
    merged = scores.merge_stats(scores.score_stats(series.filter(half)), scores.score_stats(series.filter(~half)))
    return merged.select("method", rounded("min"), rounded("max"), rounded("sum"), "count")


# --- fusion -------------------------------------------------------------------

_WIDE_SQL = ", ".join(
    f"((event_id * {k}) % 1000) / 1000.0::DOUBLE * {w} AS {m}"
    for m, k, w in zip(fixed.METHODS, (37, 53, 71, 97, 113), ("1.0::DOUBLE", "0.9::DOUBLE", "0.8::DOUBLE", "0.7::DOUBLE", "0.6::DOUBLE"))
)
_WIDE = f"WITH wide AS (SELECT event_id, {_WIDE_SQL} FROM events)"


def _wide(spark, sf):
    events = table(spark, sf, "events")
    return events.select(
        "event_id",
        *[
            (F.pmod(F.col("event_id") * k, F.lit(1000)) / F.lit(1000.0) * F.lit(w)).alias(m)
            for m, k, w in zip(fixed.METHODS, (37, 53, 71, 97, 113), (1.0, 0.9, 0.8, 0.7, 0.6))
        ],
    )


@query("fused_by_max", _WIDE + " SELECT event_id, round(greatest(knn, cluster, lof, iforest, reconstruction), 6) AS ensemble FROM wide")
def _fmax(spark, sf):
    return fusion.fuse_max(_wide(spark, sf)).select("event_id", rounded("ensemble"))


@query(
    "max_fusion_shares",
    _WIDE
    + """, t AS (SELECT CASE greatest(knn, cluster, lof, iforest, reconstruction) WHEN knn THEN 'knn' WHEN cluster THEN 'cluster' WHEN lof THEN 'lof' WHEN iforest THEN 'iforest' ELSE 'reconstruction' END AS m FROM wide)
    SELECT method, round(coalesce(n, 0) / (SELECT count(*) FROM wide), 6) AS weight FROM (SELECT unnest(['knn', 'cluster', 'lof', 'iforest', 'reconstruction']) AS method) LEFT JOIN (SELECT m, count(*) AS n FROM t GROUP BY ALL) ON m = method""",
)
def _shares(spark, sf):
    return fusion.max_shares(_wide(spark, sf)).select("method", rounded("weight"))


@query("fused_by_mean", _WIDE + " SELECT event_id, round((knn + cluster + lof + iforest + reconstruction) / 5, 6) AS ensemble FROM wide")
def _fmean(spark, sf):
    return fusion.fuse_mean(_wide(spark, sf)).select("event_id", rounded("ensemble"))


@query(
    "fused_by_static_weights",
    _WIDE
    + ", w AS (SELECT exp(0.5) AS a, exp(0.2) AS b, exp(0.1) AS c) SELECT event_id, round((knn * a + cluster * b + lof * c + iforest * c + reconstruction * c) / (a + b + 3 * c), 6) AS ensemble FROM wide, w",
)
def _fstatic(spark, sf):
    return fusion.fuse_static(_wide(spark, sf), [0.5, 0.2, 0.1, 0.1, 0.1]).select("event_id", rounded("ensemble"))


@query(
    "fused_by_variance_weights",
    _WIDE
    + ", v AS (SELECT var_pop(knn) AS a, var_pop(cluster) AS b, var_pop(lof) AS c, var_pop(iforest) AS d, var_pop(reconstruction) AS e FROM wide) "
    "SELECT event_id, round((knn * a + cluster * b + lof * c + iforest * d + reconstruction * e) / (a + b + c + d + e), 6) AS ensemble FROM wide, v",
)
def _fdynamic(spark, sf):
    return fusion.fuse_dynamic(_wide(spark, sf)).select("event_id", rounded("ensemble"))


@query("fused_by_uniform_weights", _WIDE + " SELECT event_id, round(0.2::DOUBLE * (knn + cluster + lof + iforest + reconstruction), 6) AS ensemble FROM wide")
def _funiform(spark, sf):
    return fusion.fuse_dynamic(_wide(spark, sf), uniform=True).select("event_id", rounded("ensemble"))


_LONG = _WIDE + ", long AS (UNPIVOT wide ON knn, cluster, lof, iforest, reconstruction INTO NAME method VALUE score), v AS (SELECT method, var_pop(score) AS variance FROM long GROUP BY ALL)"


@query("variance_weights", _LONG + " SELECT method, round(variance, 6) AS variance, round(variance / ((SELECT sum(variance) FROM v) + 1e-8), 6) AS weight FROM v")
def _weights(spark, sf):
    return fusion.variance_weights(fusion.to_long(_wide(spark, sf), "event_id")).select("method", rounded("variance"), rounded("weight"))


@query(
    "ordered_variance_weights",
    _LONG + " SELECT CAST(list_position(['knn', 'cluster', 'lof', 'iforest', 'reconstruction'], method) - 1 AS INTEGER) AS position, method, round(variance / (SELECT sum(variance) FROM v), 6) AS weight FROM v",
)
def _ordered(spark, sf):
    weights = fusion.variance_weights(fusion.to_long(_wide(spark, sf), "event_id"))
    return fusion.ordered_weights(weights).select("position", "method", rounded("weight"))


@query(
    "variance_bands",
    _LONG
    + " SELECT method, CASE WHEN variance / m > 0.8 THEN '极强的区分力' WHEN variance / m > 0.6 THEN '很好的区分力' WHEN variance / m > 0.4 THEN '中等区分力' WHEN variance / m > 0.2 THEN '较弱区分力' ELSE '很弱区分力' END AS quality FROM v, (SELECT max(variance) AS m FROM v)",
)
def _bands(spark, sf):
    return fusion.variance_bands(fusion.variance_weights(fusion.to_long(_wide(spark, sf), "event_id"))).select("method", "quality")


@query("chosen_method_score", _WIDE + " SELECT event_id, round(lof, 6) AS score FROM wide")
def _chosen(spark, sf):
    return fusion.choose_method(fusion.fuse_mean(_wide(spark, sf)), "lof").select("event_id", rounded("score"))


@query(
    "batch_fusion_weights",
    _WIDE
    + """, long AS (UNPIVOT (SELECT event_id // 1000 AS batch, * EXCLUDE (event_id) FROM wide) ON knn, cluster, lof, iforest, reconstruction INTO NAME method VALUE score),
    b AS (SELECT batch, method, min(score) AS min, max(score) AS max, avg(score) AS mean, stddev_pop(score) AS std, var_pop(score) AS var FROM long GROUP BY ALL),
    w AS (SELECT *, var / sum(var) OVER (PARTITION BY batch) AS weight FROM b)
    SELECT method, round(avg(weight), 6) AS weight, round(avg(min), 6) AS min, round(avg(max), 6) AS max, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM w GROUP BY ALL""",
)
def _batches(spark, sf):
    wide = _wide(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 1000))
    long = wide.drop("event_id").unpivot(["batch"], fixed.METHODS, "method", "score")
    spread = long.groupBy("batch", "method").agg(F.var_pop("score").alias("v"))
    total = spread.groupBy("batch").agg(F.sum("v").alias("t"))
    weights = spread.join(total, "batch").select("batch", "method", (F.col("v") / F.col("t")).alias("weight"))
    return fusion.batch_weights(weights, long).select("method", *[rounded(c) for c in ("weight", "min", "max", "mean", "std")])


# --- whole detections ---------------------------------------------------------


@query("detected_vectors")
def _detected(spark, sf):
    bank = features.build_bank(table(spark, sf, "embeddings"), "vec_id", "embedding")
    found = scoring.score(_embeddings(spark, sf), scoring.fit_detector(bank))
    return found.select("vec_id", *fixed.METHODS, "score", "is_anomaly")


def _detected_sequences(spark, sf):
    lines = freeze(_lines(spark, sf))
    return scoring.detect_sequences(lines, scoring.fit_on_windows(lines, 10, 64), "fixed", 10)


@query("detected_sequence_windows")
def _sequence_windows(spark, sf):
    return _detected_sequences(spark, sf).select("seq_id", "window_idx", "start_idx", "end_idx", "score", "is_anomaly")


@query("detected_sequence_summary")
def _sequence_summary(spark, sf):
    return scoring.summarize(_detected_sequences(spark, sf))


@query("sequence_scores")
def _sequence_scores(spark, sf):
    return scoring.sequence_scores(_detected_sequences(spark, sf))


@query(
    "window_run_summary",
    cte("score_series")
    + """SELECT count(*) AS num_windows, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, round(avg(score / 2), 6) AS avg_contrastive_distance,
    round(avg(score * 3), 6) AS avg_reconstruction_error, count(*) FILTER (score > 0.6) AS num_anomaly_windows, round(avg((score > 0.6)::INT), 6) AS anomaly_ratio FROM score_series""",
)
def _run_summary(spark, sf):
    series = view(spark, sf, "score_series").select(
        "score", (F.col("score") / 2).alias("contrastive_distance"), (F.col("score") * 3).alias("reconstruction_error"), (F.col("score") > 0.6).alias("is_anomaly")
    )
    one = scoring.summarize(series)
    return one.select(*[c if c.startswith("num_") else rounded(c) for c in one.columns])
