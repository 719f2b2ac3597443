"""Log, rule and anomaly queries as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.catalog.registry import newest, query
from duskwatch.catalog.views import cte, view
from duskwatch.functions.predicates import hour_between, is_ipv4, like_any, lower_like_any, moment, since
from duskwatch.operators import records as Q
from duskwatch.operators.stored_rules import run_stored_rules
from duskwatch.sources import sinks as S

_SPAN = ("2024-01-05 00:00:00", "2024-01-20 12:00:00")


@query(
    "logs_by_equality",
    cte("logs") + "SELECT * FROM logs WHERE event_type = 'failed_login' AND detected_by = 'rules' AND source_ip = '10.0.0.8'",
)
def _equality(spark, sf):
    return Q.filter_logs(view(spark, sf, "logs"), source_ip="10.0.0.8", event_type="failed_login", detected_by="rules")


@query(
    "logs_by_range",
    cte("logs")
    + f"SELECT * FROM logs WHERE event_type = 'login' AND timestamp >= TIMESTAMP '{_SPAN[0]}' AND timestamp <= TIMESTAMP '{_SPAN[1]}' ORDER BY timestamp DESC",
)
def _range(spark, sf):
    found = Q.filter_logs(view(spark, sf, "logs"), event_type="login", start=_SPAN[0], end=_SPAN[1])
    return Q.newest_first(found, tie="log_id")


@query(
    "logs_lookback_day",
    cte("logs")
    + "SELECT log_id FROM logs, (SELECT max(timestamp) AS last FROM logs) "
    "WHERE timestamp BETWEEN last - INTERVAL 24 HOUR AND last",
)
def _lookback(spark, sf):
    return view(spark, sf, "logs").filter(since("timestamp", newest(spark, sf), 24 * 60)).select("log_id")


@query(
    "logs_lookback_closed_end",
    cte("logs")
    + "SELECT log_id FROM logs, (SELECT max(timestamp) - INTERVAL 48 HOUR AS last FROM logs) "
    "WHERE timestamp BETWEEN last - INTERVAL 24 HOUR AND last",
)
def _closed(spark, sf):
    """A look-back from two days before the newest row: later rows do not count."""
    earlier = moment(newest(spark, sf)) - F.expr("INTERVAL '48' HOUR")
    return view(spark, sf, "logs").filter(since("timestamp", earlier, 24 * 60)).select("log_id")


@query(
    "filter_in_lists",
    cte("web_logs", "firewall_logs")
    + "SELECT id, method FROM web_logs WHERE status_code IN (401, 403) AND method NOT IN ('GET', 'POST', 'HEAD')",
)
def _in_lists(spark, sf):
    web = view(spark, sf, "web_logs")
    return web.filter(F.col("status_code").isin(401, 403) & ~F.col("method").isin("GET", "POST", "HEAD")).select("id", "method")


@query(
    "filter_like_any",
    cte("logs") + "SELECT log_id FROM logs WHERE message ILIKE '%FAIL%' OR message ILIKE '%Invalid%'",
)
def _like(spark, sf):
    return view(spark, sf, "logs").filter(like_any("message", ["%FAIL%", "%Invalid%"])).select("log_id")


@query("filter_lower_like", cte("web_logs") + "SELECT id FROM web_logs WHERE lower(user_agent) LIKE '%nmap%' OR lower(user_agent) LIKE '%hydra%'")
def _lower(spark, sf):
    return view(spark, sf, "web_logs").filter(lower_like_any("user_agent", ["%nmap%", "%hydra%"])).select("id")


@query("filter_night_hours", cte("logs") + "SELECT log_id FROM logs WHERE hour(timestamp) BETWEEN 0 AND 5")
def _night(spark, sf):
    return view(spark, sf, "logs").filter(hour_between("timestamp", 0, 5)).select("log_id")


@query(
    "filter_ipv4_shape",
    cte("raw_csv") + r"SELECT event_id, regexp_matches(split_part(line, ',', 2), '^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$') AS valid FROM raw_csv",
)
def _ipv4(spark, sf):
    lines = view(spark, sf, "raw_csv")
    return lines.select("event_id", is_ipv4(F.split_part("line", F.lit(","), F.lit(2))).alias("valid"))


@query("filter_scores_above", cte("score_series") + "SELECT idx FROM score_series WHERE score > 0.6")
def _above(spark, sf):
    return view(spark, sf, "score_series").filter(F.col("score") > 0.6).select("idx")


@query(
    "windows_by_band_and_text",
    cte("scored_labels")
    + "SELECT doc_id, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS band FROM scored_labels "
    "WHERE score <= 0.4 AND contains(lower(text), 'the')",
)
def _band(spark, sf):
    return Q.filter_scored(view(spark, sf, "scored_labels"), "low", "The").select("doc_id", "band")


@query(
    "anomalies_with_rule_names",
    cte("anomalies", "rules")
    + "SELECT a.*, r.name AS rule_name FROM anomalies a LEFT JOIN rules r ON a.rule_id = r.rule_id",
)
def _named(spark, sf):
    return Q.anomalies_of_logs(view(spark, sf, "anomalies"), view(spark, sf, "rules"))


@query(
    "high_risk_anomalies",
    cte("anomalies", "logs")
    + "SELECT a.*, l.source_ip, l.event_type FROM anomalies a JOIN logs l ON a.log_id = l.log_id "
    "WHERE a.score >= 0.7 OR a.detected_by = 'rules' ORDER BY a.score DESC NULLS LAST, a.anomaly_id LIMIT 100",
)
def _risk(spark, sf):
    return Q.high_risk(view(spark, sf, "anomalies"), view(spark, sf, "logs"))


@query(
    "anomaly_listing",
    cte("anomalies", "logs")
    + "SELECT a.anomaly_id AS id, l.source_ip AS source, a.anomaly_type AS event_category, 'anomaly' AS data_type, "
    "l.timestamp AS event_time, l.message AS description FROM anomalies a JOIN logs l ON a.log_id = l.log_id "
    f"WHERE l.timestamp >= TIMESTAMP '{_SPAN[0]}' AND l.timestamp <= TIMESTAMP '{_SPAN[1]}'",
)
def _listing(spark, sf):
    return Q.anomaly_listing(view(spark, sf, "anomalies"), view(spark, sf, "logs"), *_SPAN)


for _table in ("ssh_logs", "web_logs", "anomalies"):
    _ts = "created_at" if _table == "anomalies" else "timestamp"

    def _hours(spark, sf, source=_table, ts=_ts):
        return Q.per_hour(view(spark, sf, source), ts)

    query(
        f"{_table}_per_hour",
        cte(_table) + f"SELECT strftime({_ts}, '%H') AS hour, count(*) AS count FROM {_table} GROUP BY ALL",
    )(_hours)


@query("anomaly_counts_per_type", cte("anomalies") + "SELECT anomaly_type AS type, count(*) AS count FROM anomalies GROUP BY ALL")
def _types(spark, sf):
    return Q.per_type(view(spark, sf, "anomalies"))


@query(
    "failure_counts_by_user_and_source",
    cte("logs")
    + """SELECT "user", source_ip, count(*) AS count, max(timestamp) AS last_seen FROM logs WHERE message ILIKE '%fail%' GROUP BY ALL""",
)
def _failures(spark, sf):
    logs = view(spark, sf, "logs").filter(like_any("message", ["%fail%"]))
    return logs.groupBy("user", "source_ip").agg(F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("last_seen"))


@query(
    "countries_per_user",
    cte("ssh_logs", "geo_ranges")
    + """, n AS (SELECT "user", CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536
      + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS ip FROM ssh_logs)
    SELECT "user", string_agg(DISTINCT coalesce(country, 'UNKNOWN'), ',' ORDER BY coalesce(country, 'UNKNOWN')) AS countries
    FROM n LEFT JOIN geo_ranges ON ip BETWEEN ip_start AND ip_end GROUP BY "user" """,
)
def _countries(spark, sf):
    from duskwatch.operators.geo import with_country

    pairs = view(spark, sf, "ssh_logs").select("user", "source_ip").distinct()
    located = with_country(pairs, view(spark, sf, "geo_ranges"), "source_ip").select("user", "country").distinct()
    return located.groupBy("user").agg(F.array_join(F.sort_array(F.collect_list("country")), ",").alias("countries"))


@query(
    "logs_with_country",
    cte("ssh_logs", "geo_ranges")
    + """, n AS (SELECT id, CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536
      + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS ip FROM ssh_logs)
    SELECT id, coalesce(country, 'UNKNOWN') AS country FROM n LEFT JOIN geo_ranges ON ip BETWEEN ip_start AND ip_end""",
)
def _located(spark, sf):
    from duskwatch.operators.geo import with_country

    return with_country(view(spark, sf, "ssh_logs"), view(spark, sf, "geo_ranges"), "source_ip").select("id", "country")


# --- validated writes ---------------------------------------------------------

_NEW_LOGS = """SELECT log_id, CASE WHEN log_id % 13 = 0 THEN 'invalid.ip' WHEN log_id % 17 = 0 THEN NULL ELSE source_ip END AS source_ip,
    event_type, CASE WHEN log_id % 19 = 0 THEN NULL ELSE message END AS message,
    CASE WHEN log_id % 7 = 0 THEN 'wrong' WHEN log_id % 5 = 0 THEN NULL ELSE detected_by END AS detected_by, timestamp FROM {logs}"""
_REJECT_SQL = """concat_ws('; ', CASE WHEN source_ip IS NULL THEN 'missing source_ip' END, CASE WHEN message IS NULL THEN 'missing message' END,
    CASE WHEN source_ip IS NOT NULL AND NOT regexp_matches(source_ip, '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$') THEN 'Invalid IP address format' END,
    CASE WHEN detected_by = 'wrong' THEN 'Invalid status' END)"""


def _new_logs(spark, sf):
    return spark.sql(_NEW_LOGS, logs=view(spark, sf, "logs"))


@query(
    "valid_new_logs",
    cte("logs") + f", fresh AS ({_NEW_LOGS.format(logs='logs')}) SELECT log_id, source_ip, event_type, message, coalesce(detected_by, 'none') AS detected_by "
    f"FROM fresh WHERE {_REJECT_SQL} = ''",
)
def _valid(spark, sf):
    return S.validate_logs(_new_logs(spark, sf))[0].select("log_id", "source_ip", "event_type", "message", "detected_by")


@query(
    "rejected_new_logs",
    cte("logs") + f", fresh AS ({_NEW_LOGS.format(logs='logs')}) SELECT log_id, {_REJECT_SQL} AS reasons FROM fresh WHERE {_REJECT_SQL} <> ''",
)
def _rejected(spark, sf):
    rejected = S.validate_logs(_new_logs(spark, sf))[1]
    return rejected.select("log_id", F.array_join("reject_reasons", "; ").alias("reasons"))


@query(
    "valid_new_anomalies",
    cte("anomalies") + "SELECT anomaly_id, CASE WHEN anomaly_id % 4 = 0 THEN 'none' ELSE detected_by END AS detected_by FROM anomalies WHERE anomaly_id % 4 <> 0",
)
def _valid_anomalies(spark, sf):
    changed = F.when(F.col("anomaly_id") % 4 == 0, "none").otherwise(F.col("detected_by"))
    return S.validate_anomalies(view(spark, sf, "anomalies").withColumn("detected_by", changed))[0].select("anomaly_id", "detected_by")


@query(
    "missing_references",
    cte("anomalies", "logs", "rules") + "SELECT anomaly_id, 'rule' AS missing FROM anomalies a WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.rule_id = a.rule_id)",
)
def _references(spark, sf):
    return S.check_references(view(spark, sf, "anomalies"), view(spark, sf, "logs"), view(spark, sf, "rules"))


@query(
    "updated_detection_status",
    cte("anomalies", "logs")
    + """, u AS (SELECT log_id, detected_by FROM anomalies UNION ALL SELECT log_id, 'rules' FROM logs WHERE event_type = 'failed_login' AND "user" = 'root'),
    m AS (SELECT log_id, bool_or(detected_by IN ('rules', 'both')) AS r, bool_or(detected_by IN ('AI', 'both')) AS a FROM u GROUP BY ALL)
    SELECT l.log_id, CASE WHEN r AND a THEN 'both' WHEN r THEN 'rules' WHEN a THEN 'AI' ELSE l.detected_by END AS detected_by
    FROM logs l LEFT JOIN m ON l.log_id = m.log_id""",
)
def _status(spark, sf):
    logs = view(spark, sf, "logs")
    extra = logs.filter("event_type = 'failed_login' AND user = 'root'").select("log_id", F.lit("rules").alias("detected_by"))
    updates = view(spark, sf, "anomalies").select("log_id", "detected_by").unionByName(extra)
    return S.update_status(logs, updates).select("log_id", "detected_by")


@query(
    "valid_rules",
    cte("rules") + "SELECT rule_id, name, action FROM rules",
)
def _valid_rules(spark, sf):
    return S.validate_rules(view(spark, sf, "rules"))[0].select("rule_id", "name", "action")


# --- set operations -----------------------------------------------------------


@query(
    "distinct_sources",
    cte("firewall_logs", "ssh_logs") + "SELECT DISTINCT source_ip FROM firewall_logs UNION SELECT source_ip FROM ssh_logs",
)
def _distinct(spark, sf):
    return view(spark, sf, "firewall_logs").select("source_ip").union(view(spark, sf, "ssh_logs").select("source_ip")).distinct()


@query(
    "anomaly_bag_of_all_types",
    cte("web_logs", "firewall_logs")
    + "SELECT source_ip, method, CAST(NULL AS VARCHAR) AS dest_ip FROM web_logs WHERE method = 'PUT' UNION ALL "
    "SELECT source_ip, NULL, dest_ip FROM firewall_logs WHERE action = 'DROP'",
)
def _bag(spark, sf):
    web = view(spark, sf, "web_logs").filter("method = 'PUT'").select("source_ip", "method")
    fire = view(spark, sf, "firewall_logs").filter("action = 'DROP'").select("source_ip", "dest_ip")
    return web.unionByName(fire, allowMissingColumns=True)


# --- described extras ---------------------------------------------------------


_STORED = (
    cte("logs", "anomalies", "stored_rules")
    + """, k AS (SELECT *, rule_id % 7 AS kind FROM stored_rules), top AS (SELECT max(log_id) AS log_id FROM logs GROUP BY source_ip HAVING count(*) > 3),
    h AS (SELECT l.log_id, k.rule_id FROM logs l, k WHERE (kind = 0 AND event_type = 'failed_login' AND l.log_id % 50 = k.rule_id % 50)
        OR (kind = 1 AND "user" = 'root' AND hour(l.timestamp) < 6) OR (kind = 6 AND (detected_by = 'AI' OR message IS NULL))
      UNION ALL SELECT a.log_id, k.rule_id FROM anomalies a JOIN k ON kind = 2 AND a.score > (10 + k.rule_id % 80) / 100.0
      UNION ALL SELECT top.log_id, k.rule_id FROM top, k WHERE kind = 3)"""
)


def _rules_and_tables(spark, sf):
    return view(spark, sf, "stored_rules"), {n: view(spark, sf, n) for n in ("logs", "anomalies")}


@query(
    "stored_sql_rules",
    _STORED + " SELECT h.log_id, h.rule_id, r.name AS anomaly_type, r.description, 'rules' AS detected_by, CAST(1.0 AS DOUBLE) AS score FROM h JOIN stored_rules r ON h.rule_id = r.rule_id",
)
def _stored(spark, sf):
    return run_stored_rules(*_rules_and_tables(spark, sf))[0]


@query("stored_sql_rule_failures", cte("stored_rules") + "SELECT rule_id, name FROM stored_rules WHERE rule_id % 7 IN (4, 5)")
def _stored_failures(spark, sf):
    return run_stored_rules(*_rules_and_tables(spark, sf))[1].select("rule_id", "name")


@query(
    "rules_and_model_merged",
    cte("logs", "anomalies")
    + """SELECT coalesce(r.log_id, m.log_id) AS log_id, CASE WHEN r.log_id IS NOT NULL AND m.log_id IS NOT NULL THEN 'both'
      WHEN r.log_id IS NOT NULL THEN 'rules' ELSE 'AI' END AS detected_by, m.score
    FROM (SELECT log_id FROM logs WHERE message ILIKE '%admin%') r FULL JOIN (SELECT log_id, max(score) AS score FROM anomalies WHERE score > 0.5 GROUP BY ALL) m ON r.log_id = m.log_id""",
)
def _merged(spark, sf):
    hits = view(spark, sf, "logs").filter(like_any("message", ["%admin%"])).select("log_id")
    return Q.merge_detections(hits, view(spark, sf, "anomalies").filter("score > 0.5"))


@query(
    "brute_force_by_source_and_user",
    cte("ssh_logs")
    + """SELECT source_ip, "user", date_trunc('day', timestamp) AS window_start, count(*) AS attempts FROM ssh_logs
    WHERE event_type = 'authentication_failure' GROUP BY ALL HAVING count(*) >= 2""",
)
def _by_user(spark, sf):
    from duskwatch.operators import rules as R

    rule = R.SSH_BRUTE_FORCE.tuned(
        threshold=1, keys=("source_ip", "user"), where=lambda: F.col("event_type") == "authentication_failure"
    )
    return R.count_windows(view(spark, sf, "ssh_logs"), rule, "1 day").select("source_ip", "user", "window_start", "attempts")


@query(
    "sensitive_users_off_whitelist",
    cte("logs", "blacklist") + """SELECT log_id FROM logs l WHERE "user" IN ('admin', 'root')
    AND NOT EXISTS (SELECT 1 FROM blacklist b WHERE b.source_ip = l.source_ip)""",
)
def _sensitive(spark, sf):
    return Q.sensitive_logins(view(spark, sf, "logs"), ["admin", "root"], view(spark, sf, "blacklist")).select("log_id")


@query(
    "web_scans_per_minute",
    cte("web_logs")
    + "SELECT source_ip, count(*) AS errors FROM web_logs WHERE status_code = 404 AND timestamp >= (SELECT max(timestamp) FROM web_logs) - INTERVAL 20160 MINUTE GROUP BY ALL HAVING count(*) >= 3",
)
def _scans(spark, sf):
    from duskwatch.operators import rules as R

    rule = R.WEB_SCANNER.tuned(minutes=14 * 1440, threshold=2)
    return R.count_keys(view(spark, sf, "web_logs"), rule, newest(spark, sf)).select("source_ip", "errors")


@query(
    "sql_injection_by_regex",
    cte("web_logs") + r"SELECT id FROM web_logs WHERE regexp_matches(path, '(?i)(union\s+(all\s+)?select|drop\s+table|%27|\b1\s*=\s*1\b)')",
)
def _regex(spark, sf):
    return view(spark, sf, "web_logs").filter(
        F.col("path").rlike(r"(?i)(union\s+(all\s+)?select|drop\s+table|%27|\b1\s*=\s*1\b)")
    ).select("id")


@query(
    "off_hours_employee_logins",
    cte("logs", "mysql_logs")
    + """SELECT log_id FROM logs WHERE (hour(timestamp) < 8 OR hour(timestamp) > 18) AND "user" IN (SELECT DISTINCT "user" FROM logs WHERE event_type = 'login' AND "user" <> 'admin')""",
)
def _off_hours(spark, sf):
    logs = view(spark, sf, "logs")
    employees = logs.filter("event_type = 'login' AND user <> 'admin'").select("user")
    return Q.off_hours_logins(logs, employees).select("log_id")


@query(
    "log_page",
    cte("logs")
    + "SELECT log_id, source_ip, (SELECT count(*) FROM logs WHERE event_type = 'login') AS total FROM logs WHERE event_type = 'login' ORDER BY timestamp, log_id LIMIT 50 OFFSET 100",
)
def _page(spark, sf):
    logs = view(spark, sf, "logs").filter("event_type = 'login'").select("log_id", "timestamp", "source_ip")
    return Q.page(logs, ["timestamp", "log_id"], 3, 50).drop("timestamp")


@query(
    "dashboard_counts",
    cte("anomalies", "logs")
    + """, j AS (SELECT CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' ELSE 'low' END AS severity, anomaly_type, source_ip
      FROM anomalies a LEFT JOIN logs l ON a.log_id = l.log_id WHERE a.created_at >= date_trunc('month', (SELECT max(ts) FROM events)))
    SELECT 'severity' AS section, severity AS item, count(*) AS count FROM j GROUP BY ALL UNION ALL
    SELECT 'type', anomaly_type, count(*) FROM j GROUP BY ALL UNION ALL
    (SELECT 'source', source_ip, count(*) AS c FROM j GROUP BY ALL ORDER BY c DESC, source_ip LIMIT 10)""",
)
def _dashboard(spark, sf):
    return Q.dashboard(view(spark, sf, "anomalies"), view(spark, sf, "logs"), newest(spark, sf))


@query(
    "anomaly_details",
    cte("anomalies", "logs", "rules")
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY anomaly_type ORDER BY created_at DESC, anomaly_id DESC) AS n FROM anomalies)
    SELECT a.anomaly_id, l.source_ip, l.message, u.name AS rule_name, (SELECT string_agg(CAST(anomaly_id AS VARCHAR), ',' ORDER BY n) FROM
      (SELECT anomaly_id, n FROM r WHERE r.anomaly_type = a.anomaly_type AND r.anomaly_id <> a.anomaly_id AND r.n <= 6 ORDER BY n LIMIT 5)) AS related
    FROM anomalies a LEFT JOIN logs l ON a.log_id = l.log_id LEFT JOIN rules u ON a.rule_id = u.rule_id""",
)
def _details(spark, sf):
    out = Q.anomaly_details(view(spark, sf, "anomalies"), view(spark, sf, "logs"), view(spark, sf, "rules"))
    return out.select("anomaly_id", "source_ip", "message", "rule_name", F.array_join("related_ids", ",").alias("related"))


@query(
    "frequent_words",
    cte("logs")
    + r"""SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(message,
      '\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}.\d{3}', '', 'g'), '\b(INFO|DEBUG|ERROR|WARNING|WARN|TRACE)\b', '', 'g'), '\s+', ' ', 'g')), '[^a-zA-Z0-9\s]', '', 'g')), '\s+')) AS word FROM logs)
    WHERE word <> '' GROUP BY ALL ORDER BY count DESC, word LIMIT 20""",
)
def _words(spark, sf):
    return Q.word_counts(view(spark, sf, "logs"))


@query(
    "log_entities",
    cte("logs")
    + r"""SELECT log_id, list_aggregate(regexp_extract_all(message, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}'), 'string_agg', ',') AS ips,
    list_aggregate(regexp_extract_all(message, 'user=(\w+)', 1), 'string_agg', ',') AS users FROM logs""",
)
def _entities(spark, sf):
    from duskwatch.functions.text import ips, user_mentions

    def joined(values):
        return F.when(F.size(values) > 0, F.array_join(values, ","))

    return view(spark, sf, "logs").select("log_id", joined(ips("message")).alias("ips"), joined(user_mentions("message")).alias("users"))


@query(
    "masked_messages",
    cte("logs")
    + r"""SELECT log_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(message, '\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?', '[TIME]', 'g'),
    '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}', '[IP]', 'g'), '(/[A-Za-z0-9_.-]+)+/?', '[PATH]', 'g'), 'user=\w+', 'user=[USER]', 'g') AS masked FROM logs""",
)
def _masked(spark, sf):
    from duskwatch.functions.text import mask

    return view(spark, sf, "logs").select("log_id", mask("message", {r"user=\w+": "user=[USER]"}).alias("masked"))


@query(
    "sources_seen_in_two_logs",
    cte("ssh_logs", "firewall_logs")
    + """SELECT s.source_ip, s.timestamp, any_value(s.n) AS rows, count(f.id) AS matches FROM (SELECT source_ip, timestamp, count(*) AS n FROM ssh_logs GROUP BY ALL) s
    LEFT JOIN firewall_logs f ON f.source_ip = s.source_ip AND f.timestamp BETWEEN s.timestamp - INTERVAL 3600 SECOND AND s.timestamp + INTERVAL 3600 SECOND GROUP BY ALL""",
)
def _correlated(spark, sf):
    return Q.correlate(view(spark, sf, "ssh_logs"), view(spark, sf, "firewall_logs"), "source_ip", 3600)


@query(
    "event_type_steps",
    cte("logs")
    + """SELECT previous, event_type, count(*) AS count FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY source_ip ORDER BY timestamp, log_id) AS previous FROM logs)
    WHERE previous IS NOT NULL GROUP BY ALL""",
)
def _steps(spark, sf):
    return Q.event_steps(view(spark, sf, "logs"))


@query("recent_logs_per_hour_and_type", cte("logs") + "SELECT strftime(timestamp, '%H') AS hour, event_type, count(*) AS count FROM logs GROUP BY ALL")
def _hour_type(spark, sf):
    from duskwatch.functions.timecols import hour_text

    return view(spark, sf, "logs").groupBy(hour_text("timestamp").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("count"))
