"""Rule detectors as registered queries.

Windows and thresholds are wider than the library defaults, because the test
tables spread few events over a month.
"""

from __future__ import annotations

from duskwatch.catalog.registry import newest, query
from duskwatch.catalog.views import cte, view
from duskwatch.functions import fixed_values as fixed
from duskwatch.operators import rules as R
from duskwatch.plans.ordering import lookback_counts, sessions
from pyspark.sql import functions as F

DAY = 24 * 60
WEEK = 7 * DAY
MONTH = 60 * DAY


def _text(pattern: str, *parts: str) -> str:
    """A printf text as a DuckDB concatenation."""
    pieces = pattern.split("%s")
    out = []
    for i, piece in enumerate(pieces):
        if piece:
            out.append(f"'{piece}'")
        if i < len(parts):
            out.append(f"CAST({parts[i]} AS VARCHAR)")
    return " || ".join(out)


# name -> (rule, table, SQL condition, SQL measure)
COUNTED = {
    "ssh_brute_force": (R.SSH_BRUTE_FORCE.tuned(WEEK, 3), "ssh_logs", "event_type IN ('authentication_failure', 'invalid_user')", "count(*)"),
    "ssh_user_enumeration": (R.SSH_USER_ENUMERATION.tuned(WEEK, 1), "ssh_logs", "event_type = 'invalid_user'", 'count(DISTINCT "user")'),
    "ssh_reverse_dns_failure": (R.SSH_REVERSE_DNS.tuned(DAY), "ssh_logs", "event_type = 'reverse_dns_failure'", "count(*)"),
    "ssh_high_frequency": (R.SSH_HIGH_FREQUENCY.tuned(DAY, 3), "ssh_logs", "TRUE", "count(*)"),
    "ssh_port_scan": (R.SSH_PORT_SCAN.tuned(DAY, 4), "ssh_logs", "TRUE", "count(*)"),
    "ssh_global_ddos": (R.SSH_GLOBAL_DDOS.tuned(DAY, 10), "ssh_logs", "event_type = 'invalid_user'", "count(*)"),
    "ssh_distinct_ports": (R.SSH_DISTINCT_PORTS.tuned(WEEK, 3), "ssh_attempts", "event_type IN ('connection_attempt', 'invalid_port')", "count(DISTINCT port)"),
    "ssh_protocol_anomaly": (R.SSH_PROTOCOL.tuned(MONTH, 0), "ssh_attempts", "event_type = 'connection_attempt' AND port <> 22", "count(*)"),
    "web_brute_force": (R.WEB_BRUTE_FORCE.tuned(WEEK, 2), "web_logs", "status_code IN (401, 403)", "count(*)"),
    "web_scanner": (R.WEB_SCANNER.tuned(WEEK, 1), "web_logs", "status_code = 404", "count(*)"),
    "web_high_frequency": (R.WEB_HIGH_FREQUENCY.tuned(MONTH, 4), "web_logs", "TRUE", "count(*)"),
    "firewall_port_scan": (R.FIREWALL_PORT_SCAN.tuned(WEEK, 2), "firewall_logs", "action = 'DROP'", "count(DISTINCT dest_port)"),
    "firewall_ddos": (R.FIREWALL_DDOS.tuned(MONTH, 0), "firewall_logs", "protocol = 'TCP' AND dest_port = 80 AND action = 'DROP'", "count(*)"),
    "mysql_brute_force": (R.MYSQL_BRUTE_FORCE.tuned(WEEK, 2), "mysql_logs", "event_type = 'auth_failure'", "count(*)"),
    "hdfs_service_brute_force": (R.HDFS_SERVICE.tuned(WEEK, 3), "hdfs_logs", "Eventid = 'E3'", "count(*)"),
    "hdfs_abnormal_deletions": (R.HDFS_DELETIONS.tuned(WEEK, 1), "hdfs_logs", "Eventid IN ('E4', 'E8')", "count(*)"),
    "hdfs_transmission_failures": (R.HDFS_TRANSMISSION.tuned(WEEK, 5), "hdfs_logs", "Eventid = 'E10'", "count(*)"),
}

# name -> (rule, table, SQL condition)
FLAGGED = {
    "web_sql_injection": (R.WEB_SQL_INJECTION, "web_logs", "path ILIKE '%UNION%SELECT%' OR path ILIKE '%1=1%' OR path ILIKE '%DROP%TABLE%'"),
    "web_xss": (R.WEB_XSS, "web_logs", "path ILIKE '%<script>%' OR path ILIKE '%alert(%'"),
    "web_directory_traversal": (R.WEB_TRAVERSAL, "web_logs", "path ILIKE '%/../%' OR path ILIKE '%/etc/passwd%' OR path ILIKE '%/win.ini%'"),
    "web_sensitive_files": (R.WEB_SENSITIVE, "web_logs", "path ILIKE '%/.git/config%' OR path ILIKE '%/wp-admin/%' OR path ILIKE '%/phpmyadmin/%'"),
    "web_suspicious_agent": (R.WEB_AGENT, "web_logs", "lower(user_agent) LIKE '%sqlmap%' OR lower(user_agent) LIKE '%nmap%' OR lower(user_agent) LIKE '%hydra%'"),
    "web_abnormal_method": (R.WEB_METHOD, "web_logs", "method NOT IN ('GET', 'POST', 'HEAD')"),
    "firewall_abnormal_protocol": (R.FIREWALL_PROTOCOL, "firewall_logs", "protocol = 'UDP' AND dest_port IN (137, 138, 139, 445)"),
    "firewall_internal_outbound": (R.FIREWALL_OUTBOUND, "firewall_logs", "source_ip LIKE '192.168.%' AND dest_ip NOT LIKE '192.168.%' AND action = 'DROP'"),
    "mysql_high_risk_sql": (R.MYSQL_HIGH_RISK, "mysql_logs", "event_type = 'high_risk_operation' AND sql_statement ILIKE '%DROP%TABLE%'"),
    "mysql_privilege_change": (R.MYSQL_PRIVILEGE, "mysql_logs", "sql_statement ILIKE '%GRANT%ALL%' OR sql_statement ILIKE '%REVOKE%'"),
    "mysql_data_exfiltration": (R.MYSQL_EXPORT, "mysql_logs", "sql_statement ILIKE 'SELECT%*%FROM%' AND sql_statement NOT ILIKE '%LIMIT%'"),
    "mysql_off_hours": (R.MYSQL_OFF_HOURS, "mysql_logs", "hour(timestamp) BETWEEN 0 AND 5"),
}


def _quoted(columns) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def _count_sql(rule: R.CountRule, source: str, where: str, measure: str, shared: bool = False) -> str:
    named = {"metric": rule.metric, "minutes": str(rule.minutes)}
    reason = _text(rule.reason, *[named.get(c, f'"{c}"') for c in rule.reason_columns])
    keys = _quoted(rule.keys)
    shown = "".join(f', max("{c}") AS "{c}"' for c in rule.shown)
    inner = (
        f"SELECT {keys + ', ' if keys else ''}{measure} AS {rule.metric}{shown} FROM {source} "
        f"WHERE ({where}) AND timestamp >= (SELECT max(timestamp) FROM {source}) - INTERVAL {rule.minutes} MINUTE "
        + (f"GROUP BY {keys}" if keys else "")
    )
    if shared:
        columns = {
            "source_ip": "VARCHAR", "user": "VARCHAR", "pid": "BIGINT",
        }
        picked = ", ".join(
            f'CAST({chr(34) + c + chr(34) if c in rule.keys + rule.shown else "NULL"} AS {t}) AS "{c}"'
            for c, t in columns.items()
        )
        rest = [c for c in rule.keys if c not in columns]
        item = " || ' ' || ".join(f"CAST({c} AS VARCHAR)" for c in rest) if rest else "NULL"
        return (
            f"SELECT '{rule.name}' AS anomaly_type, {picked}, {rule.metric} AS metric, "
            f"CAST({item} AS VARCHAR) AS item, {reason} AS reason FROM ({inner}) WHERE {rule.metric} > {rule.threshold}"
        )
    shown_columns = "".join(f', "{c}"' for c in rule.shown)
    return (
        f"SELECT '{rule.name}' AS anomaly_type{', ' + keys if keys else ''}{shown_columns}, {rule.metric}, "
        f"{reason} AS reason FROM ({inner}) WHERE {rule.metric} > {rule.threshold}"
    )


def _flag_sql(rule: R.PatternRule, source: str, where: str, shared: bool = False) -> str:
    reason = _text(rule.reason, *[f'"{c}"' for c in rule.reason_columns])
    if shared:
        rest = [c for c in rule.columns if c not in ("source_ip", "user", "pid")]
        item = " || ' ' || ".join(f"CAST({c} AS VARCHAR)" for c in rest) if rest else "NULL"
        picked = ", ".join(
            f'CAST({chr(34) + c + chr(34) if c in rule.columns else "NULL"} AS {t}) AS "{c}"'
            for c, t in {"source_ip": "VARCHAR", "user": "VARCHAR", "pid": "BIGINT"}.items()
        )
        return (
            f"SELECT '{rule.name}' AS anomaly_type, {picked}, CAST(NULL AS BIGINT) AS metric, "
            f"CAST({item} AS VARCHAR) AS item, {reason} AS reason FROM {source} WHERE {where}"
        )
    return (
        f"SELECT '{rule.name}' AS anomaly_type, {_quoted(rule.columns)}, {reason} AS reason "
        f"FROM {source} WHERE {where}"
    )


def _register_counted(name, rule, source, where, measure):
    @query(name, cte(source) + _count_sql(rule, source, where, measure))
    def run(spark, sf):
        return R.count_keys(view(spark, sf, source), rule, newest(spark, sf))


def _register_flagged(name, rule, source, where):
    @query(name, cte(source) + _flag_sql(rule, source, where))
    def run(spark, sf):
        return R.flag_rows(view(spark, sf, source), rule)


for _name, _spec in COUNTED.items():
    _register_counted(_name, *_spec)
for _name, _spec in FLAGGED.items():
    _register_flagged(_name, *_spec)


# --- geographic rule and blacklist -------------------------------------------

_VISITS = """
SELECT DISTINCT s."user", coalesce(g.country, 'UNKNOWN') AS country
FROM (SELECT *, CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536
    + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS ip FROM ssh_logs
  WHERE event_type = 'login_success' AND timestamp >= (SELECT max(timestamp) FROM ssh_logs) - INTERVAL 1440 MINUTE) s
LEFT JOIN geo_ranges g ON s.ip BETWEEN g.ip_start AND g.ip_end"""
_GEO = (
    f"SELECT 'geo_anomaly' AS anomaly_type, \"user\", string_agg(country, ',' ORDER BY country) AS countries, "
    f"{_text(fixed.REASON_GEO_ANOMALY, chr(34) + 'user' + chr(34), '24', 'count(*)')} AS reason "
    f"FROM ({_VISITS}) GROUP BY \"user\" HAVING count(*) > 1"
)


@query("ssh_geo_anomaly", cte("ssh_logs", "geo_ranges") + _GEO)
def _geo(spark, sf):
    found = R.geo_anomaly(view(spark, sf, "ssh_logs"), view(spark, sf, "geo_ranges"), newest(spark, sf), hours=24)
    return found.withColumn("countries", F.concat_ws(",", "countries"))


@query(
    "firewall_blacklist",
    cte("firewall_logs", "blacklist")
    + f"SELECT DISTINCT 'blacklist_ip' AS anomaly_type, source_ip, '{fixed.REASON_BLACKLIST}' AS reason "
    "FROM firewall_logs WHERE source_ip IN (SELECT source_ip FROM blacklist)",
)
def _blacklist(spark, sf):
    return R.blacklist_hits(view(spark, sf, "firewall_logs"), view(spark, sf, "blacklist"))


# --- whole rule sets ----------------------------------------------------------

SETS = {
    "ssh": ["ssh_brute_force", "ssh_user_enumeration", "ssh_reverse_dns_failure", "ssh_high_frequency", "ssh_port_scan"],
    "web": [
        "web_sql_injection", "web_xss", "web_brute_force", "web_scanner", "web_directory_traversal",
        "web_sensitive_files", "web_suspicious_agent", "web_high_frequency", "web_abnormal_method",
    ],
    "firewall": ["firewall_port_scan", "firewall_ddos", "firewall_abnormal_protocol", "firewall_internal_outbound"],
    "mysql": ["mysql_brute_force", "mysql_high_risk_sql", "mysql_privilege_change", "mysql_data_exfiltration", "mysql_off_hours"],
    "hdfs": ["hdfs_service_brute_force", "hdfs_abnormal_deletions", "hdfs_transmission_failures"],
}


def set_rules(kind: str) -> list:
    return [(COUNTED.get(n) or FLAGGED[n])[0] for n in SETS[kind]]


def run_set(spark, sf, kind: str):
    logs = view(spark, sf, f"{kind}_logs")
    if kind == "ssh":
        return R.run_ssh(logs, view(spark, sf, "geo_ranges"), newest(spark, sf), hours=24, rules=set_rules("ssh"))
    return R.run_rules(logs, set_rules(kind), newest(spark, sf))


def _set_sql(kind: str) -> str:
    parts = []
    for n in SETS[kind]:
        if n in COUNTED:
            parts.append(_count_sql(*COUNTED[n], shared=True))
        else:
            parts.append(_flag_sql(*FLAGGED[n], shared=True))
    if kind == "ssh":
        parts.append(
            "SELECT anomaly_type, CAST(NULL AS VARCHAR) AS source_ip, \"user\", CAST(NULL AS BIGINT) AS pid, "
            f"CAST(NULL AS BIGINT) AS metric, countries AS item, reason FROM ({_GEO})"
        )
    return " UNION ALL ".join(parts)


def set_cte(kind: str) -> str:
    return cte(*(["ssh_logs", "geo_ranges"] if kind == "ssh" else [f"{kind}_logs"]))


def _register_set(kind):
    body = _set_sql(kind)

    # -1 stands for "not given", so that the result holds no null numbers
    shown = "anomaly_type, source_ip, \"user\", coalesce(pid, -1) AS pid, coalesce(metric, -1) AS metric, item, reason"

    @query(f"{kind}_all_rules", set_cte(kind) + f"SELECT {shown} FROM ({body})")
    def run(spark, sf):
        return run_set(spark, sf, kind).fillna(-1, ["pid", "metric"])

    columns = {
        "ssh": "source_ip, \"user\", anomaly_type, reason AS details, CASE WHEN anomaly_type = 'geo_anomaly' THEN item ELSE '' END AS country_codes",
        "web": "source_ip, anomaly_type, reason AS details",
        "firewall": "source_ip, anomaly_type, reason AS details",
        "mysql": "\"user\", source_ip, anomaly_type, reason AS details",
        "hdfs": "pid, anomaly_type, reason AS details",
    }[kind]

    @query(f"{kind}_anomaly_rows", set_cte(kind) + f"SELECT {columns} FROM ({body})")
    def stored(spark, sf):
        return R.stored_anomalies(run_set(spark, sf, kind), kind)

    @query(f"{kind}_anomaly_types", set_cte(kind) + f"SELECT anomaly_type, count(*) AS count FROM ({body}) GROUP BY anomaly_type")
    def types(spark, sf):
        return R.type_counts(run_set(spark, sf, kind))

    @query(f"{kind}_anomaly_total", set_cte(kind) + f"SELECT count(*) AS count FROM ({body})")
    def total(spark, sf):
        return R.run_total(run_set(spark, sf, kind))


for _kind in SETS:
    _register_set(_kind)


# --- every window instead of the last one ------------------------------------


@query(
    "ssh_brute_force_by_day",
    cte("ssh_logs")
    + """SELECT 'ssh_brute_force' AS anomaly_type, source_ip, date_trunc('day', timestamp) AS window_start,
    date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, count(*) AS attempts FROM ssh_logs
    WHERE event_type IN ('authentication_failure', 'invalid_user') GROUP BY ALL HAVING count(*) > 3""",
)
def brute_force_by_day(spark, sf):
    return R.count_windows(view(spark, sf, "ssh_logs"), R.SSH_BRUTE_FORCE.tuned(threshold=3), "1 day")


@query(
    "ssh_user_enumeration_by_day",
    cte("ssh_logs")
    + """SELECT 'user_enumeration' AS anomaly_type, source_ip, date_trunc('day', timestamp) AS window_start,
    date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, count(DISTINCT "user") AS users FROM ssh_logs
    WHERE event_type = 'invalid_user' GROUP BY ALL HAVING count(DISTINCT "user") > 1""",
)
def _enumeration_by_day(spark, sf):
    return R.count_windows(view(spark, sf, "ssh_logs"), R.SSH_USER_ENUMERATION.tuned(threshold=1), "1 day")


@query(
    "ssh_failures_lookback_every_event",
    cte("ssh_logs")
    + """SELECT source_ip, timestamp, hits FROM (SELECT DISTINCT source_ip, timestamp, count(*) OVER (PARTITION BY source_ip
    ORDER BY timestamp RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS hits FROM ssh_logs
    WHERE event_type = 'authentication_failure') WHERE hits > 3""",
)
def _every_event(spark, sf):
    failures = view(spark, sf, "ssh_logs").filter("event_type = 'authentication_failure'")
    return lookback_counts(failures, ["source_ip"], "timestamp", 86_400).filter("hits > 3")


@query(
    "alert_sessions",
    cte("ssh_logs")
    + """, gaps AS (SELECT source_ip, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opened
      FROM ssh_logs WINDOW w AS (PARTITION BY source_ip ORDER BY timestamp, id)),
    numbered AS (SELECT *, sum(opened) OVER (PARTITION BY source_ip ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS n FROM gaps)
    SELECT source_ip, min(timestamp) AS session_start, max(timestamp) AS session_last, count(*) AS hits,
      CASE WHEN count(*) > 5 THEN 'high' WHEN count(*) > 4 THEN 'medium' ELSE 'low' END AS severity
    FROM numbered GROUP BY source_ip, n HAVING count(*) > 3""",
)
def _alert_sessions(spark, sf):
    merged = sessions(view(spark, sf, "ssh_logs"), ["source_ip"], "timestamp", 6 * 3600)
    severity = F.when(F.col("hits") > 5, "high").when(F.col("hits") > 4, "medium").otherwise("low")
    return merged.filter("hits > 3").withColumn("severity", severity)
