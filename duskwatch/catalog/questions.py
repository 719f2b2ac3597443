"""Question understanding and templates as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.catalog.registry import newest, query
from duskwatch.catalog.views import _IP, cte, table, view
from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.timecols import back_from, calendar_range, parse_date
from duskwatch.operators import questions as N
from duskwatch.operators.answers import answer_questions

_ADDRESS = _IP.replace("{div}", "//")
_NOW = "(SELECT max(ts) FROM events)"


def _intents(spark, sf):
    return N.read_intent(view(spark, sf, "questions"), newest(spark, sf))


def _by_case(values: dict[int, str], other: str) -> str:
    return "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_TIME = {
    0: ("'relative'", "'hour'", "event_id % 48 + 1"),
    4: ("'relative'", "'day'", "event_id % 9 + 1"),
    8: ("'relative'", "'day'", "event_id % 5 + 1"),
}


@query(
    "question_time_ranges",
    f"""SELECT event_id AS question_id, {_by_case({1: "'special'", 9: "'special'", 5: "'absolute'"}, "'relative'")} AS time_type,
    {_by_case({k: v[1] for k, v in _TIME.items()}, "'hour'")} AS time_unit, CAST({_by_case({k: v[2] for k, v in _TIME.items()}, '24')} AS INTEGER) AS time_value,
    {_by_case({1: f"date_trunc('day', {_NOW})", 9: f"date_trunc('week', {_NOW}) - INTERVAL 7 DAY", 5: "TIMESTAMP '2024-01-05'"}, 'NULL')} AS time_start,
    {_by_case({1: f"date_trunc('day', {_NOW}) + INTERVAL 86399 SECOND", 9: f"date_trunc('week', {_NOW}) - INTERVAL 1 SECOND", 5: "TIMESTAMP '2024-01-09 12:30:00'"}, 'NULL')} AS time_end
    FROM events""",
)
def _times(spark, sf):
    return _intents(spark, sf).select("question_id", "time_type", "time_unit", "time_value", "time_start", "time_end")


@query(
    "question_entities",
    f"""SELECT event_id AS question_id, {_by_case({2: "'admin'", 4: "'root'", 11: "'admin'"}, 'NULL')} AS "user", {_by_case({3: _ADDRESS, 9: _ADDRESS}, 'NULL')} AS ip,
    {_by_case({0: "'login'", 2: "'login'", 4: "'access'", 5: "'upload'", 6: "'delete'", 8: "'download'", 10: "'login'"}, "''")} AS events,
    {_by_case({0: "'failure'", 5: "'success'", 8: "'denied'", 10: "'failure'"}, 'NULL')} AS status, event_id % 12 IN (1, 9, 10) AS anomaly,
    CAST({_by_case({6: 'event_id % 20 + 1'}, '100')} AS INTEGER) AS row_limit FROM events""",
)
def _entities(spark, sf):
    return _intents(spark, sf).select("question_id", "user", "ip", F.array_join("events", ",").alias("events"), "status", "anomaly", "row_limit")


@query(
    "question_templates",
    f"""SELECT event_id AS question_id, {_by_case({0: "'login_failures,logs'", 1: "'anomalies,logs'", 7: "'rules,logs'", 9: "'anomalies,logs'", 10: "'login_failures,anomalies,logs'"}, "'logs'")} AS kinds,
    {_by_case({0: "'login_failures'", 1: "'anomalies'", 7: "'rules'", 9: "'anomalies'", 10: "'login_failures'"}, "'logs'")} AS kind, event_id % 12 IN (9, 10) AS merge FROM events""",
)
def _templates(spark, sf):
    return _intents(spark, sf).select("question_id", F.array_join("kinds", ",").alias("kinds"), "kind", "merge")


@query(
    "question_recognition",
    f"""SELECT event_id AS question_id, {_by_case({2: "'admin'", 4: "'root'", 11: "'admin'"}, "''")} AS users, {_by_case({3: _ADDRESS, 9: _ADDRESS}, "''")} AS ips,
    {_by_case({0: "'login,failed_login'", 2: "'login'", 4: "'access'", 10: "'login,failed_login'", 11: "'login'"}, "''")} AS event_groups,
    {_by_case({0: "'failed,error'", 1: "'error'", 5: "'success'", 8: "'failed,denied'", 10: "'failed,error'"}, "''")} AS status_groups FROM events""",
)
def _recognised(spark, sf):
    found = N.recognise_entities(view(spark, sf, "questions"))
    return found.select("question_id", *[F.array_join(c, ",").alias(c) for c in ("users", "ips", "event_groups", "status_groups")])


@query(
    "question_kind_counts",
    f"""SELECT {_by_case({0: "'login_failures'", 1: "'anomalies'", 7: "'rules'", 9: "'anomalies'", 10: "'login_failures'"}, "'logs'")} AS kind, count(*) AS count FROM events GROUP BY ALL""",
)
def _kinds(spark, sf):
    return _intents(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


_LAST_DAYS = f"timestamp BETWEEN {_NOW} - INTERVAL 240 HOUR AND {_NOW}"
_FAIL = "(message ILIKE '%fail%' OR message ILIKE '%失败%' OR message ILIKE '%拒绝%' OR message ILIKE '%deny%' OR message ILIKE '%invalid%')"
_ADMIN = """(coalesce("user" ILIKE 'admin', FALSE) OR message ILIKE '%admin%')"""
_TEN_DAYS = {"time_type": "relative", "time_unit": "day", "time_value": 10}


@query(
    "template_login_failures",
    cte("logs")
    + f"""SELECT count(*) AS count, "user" AS entity_name, source_ip AS source, 'login_failure' AS event_category, 'count' AS data_type, max(timestamp) AS event_time
    FROM logs WHERE {_LAST_DAYS} AND {_ADMIN} AND {_FAIL} GROUP BY "user", source_ip""",
)
def _login(spark, sf):
    return N.login_failures(view(spark, sf, "logs"), {**_TEN_DAYS, "user": "admin"}, newest(spark, sf))


@query(
    "template_anomalies",
    cte("logs", "anomalies")
    + f"""SELECT a.anomaly_id AS id, l.source_ip AS source, a.anomaly_type AS event_category, 'anomaly' AS data_type, l.timestamp AS event_time, l.message AS description
    FROM anomalies a JOIN logs l ON a.log_id = l.log_id WHERE l.{_LAST_DAYS} AND l.event_type = 'failed_login'""",
)
def _anomalies(spark, sf):
    return N.anomaly_rows(view(spark, sf, "logs"), view(spark, sf, "anomalies"), {**_TEN_DAYS, "event": "failed_login"}, newest(spark, sf))


_RULES_SQL = "SELECT rule_id AS id, name AS entity_name, '' AS source, 'rule' AS data_type, action AS event_category, created_at AS event_time FROM rules"


@query("template_rules", cte("rules") + _RULES_SQL)
def _rules(spark, sf):
    return N.rule_rows(view(spark, sf, "rules"))


_LOGS_SQL = """SELECT log_id AS id, source_ip AS source, event_type AS event_category, 'log' AS data_type, timestamp AS event_time, message AS description FROM logs"""


@query(
    "template_logs",
    cte("logs") + f"{_LOGS_SQL} WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' AND (source_ip ILIKE '10.0.0.9' OR message ILIKE '%10.0.0.9%') ORDER BY timestamp DESC, log_id LIMIT 100",
)
def _logs(spark, sf):
    intent = {"time_type": "absolute", "time_start": "2024-01-05 00:00:00", "time_end": "2024-01-20 00:00:00", "ip": "10.0.0.9"}
    return N.log_rows(view(spark, sf, "logs"), intent, newest(spark, sf))


@query(
    "template_logs_first_n",
    cte("logs") + f"{_LOGS_SQL} WHERE {_LAST_DAYS} AND message ILIKE '%success%' ORDER BY timestamp DESC, log_id LIMIT 7",
)
def _first(spark, sf):
    return N.log_rows(view(spark, sf, "logs"), {**_TEN_DAYS, "status": "success", "row_limit": 7}, newest(spark, sf))


_MERGE_SQL = f"""SELECT CAST(id AS VARCHAR) AS id, source, event_category, data_type, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time, description FROM
    (SELECT a.anomaly_id AS id, l.source_ip AS source, a.anomaly_type AS event_category, 'anomaly' AS data_type, l.timestamp AS event_time, l.message AS description
      FROM anomalies a JOIN logs l ON a.log_id = l.log_id WHERE l.{_LAST_DAYS})
    {{op}} SELECT CAST(log_id AS VARCHAR), source_ip, event_type, 'log', strftime(timestamp, '%Y-%m-%d %H:%M:%S'), message FROM (SELECT * FROM logs WHERE {_LAST_DAYS} ORDER BY timestamp DESC, log_id LIMIT 100)"""


def _merged(spark, sf, everything):
    intent = {**_TEN_DAYS, "kinds": ["anomalies", "logs"], "merge": True}
    out = N.answer(intent, view(spark, sf, "logs"), view(spark, sf, "anomalies"), view(spark, sf, "rules"), newest(spark, sf), everything)
    return out.withColumn("event_time", F.substring("event_time", 1, 19))


@query("merged_templates", cte("logs", "anomalies") + _MERGE_SQL.format(op="UNION"))
def _union(spark, sf):
    return _merged(spark, sf, False)


@query("merged_templates_with_duplicates", cte("logs", "anomalies") + _MERGE_SQL.format(op="UNION ALL"))
def _union_all(spark, sf):
    return _merged(spark, sf, True)


def _spelled(column: str, kind: str, value: str) -> str:
    texts = " OR ".join("message ILIKE '%" + p.replace("'", "''") + "%'" for p in N.spellings(kind, value))
    return f"coalesce({column} ILIKE '{value}', FALSE) OR {texts}"


for _name, _column, _kind, _value in (
    ("user_mentions", '"user"', "user", "root"),
    ("ip_mentions", "source_ip", "source_ip", "10.0.0.12"),
    ("login_event_mentions", "event_type", "event_type", "login"),
    ("failure_event_mentions", "event_type", "event_type", "failure"),
):

    @query(_name, cte("logs") + f"SELECT log_id FROM logs WHERE {_spelled(_column, _kind, _value)}")
    def _mention(spark, sf, kind=_kind, value=_value):
        return view(spark, sf, "logs").filter(N.mentions(kind, value)).select("log_id")


@query(
    "failed_login_messages",
    cte("logs") + "SELECT log_id FROM logs WHERE " + " OR ".join(f"message ILIKE '%{p}%'" for p in fixed.FAILED_LOGIN_MESSAGES),
)
def _failed(spark, sf):
    return view(spark, sf, "logs").filter(N.failed_login()).select("log_id")


for _term in ("login success", "failed", "admin", "user=root"):

    @query(
        f"message_term_{_term.replace(' ', '_').replace('=', '_is_')}",
        cte("logs")
        + "SELECT log_id FROM logs WHERE "
        + " OR ".join("message ILIKE '%" + p.replace("'", "''") + "%'" for p in N.term_variants(_term))
        + (" OR coalesce(\"user\" ILIKE 'admin', FALSE)" if _term == "admin" else ""),
    )
    def _variants(spark, sf, term=_term):
        return view(spark, sf, "logs").filter(N.message_has(term)).select("log_id")


@query(
    "relative_times",
    f"""SELECT event_id, {_NOW} - CASE event_id % 4 WHEN 0 THEN to_hours(CAST(event_id % 30 AS INTEGER)) WHEN 1 THEN to_days(CAST(event_id % 30 AS INTEGER)) WHEN 2 THEN to_days(CAST(event_id % 30 * 7 AS INTEGER)) ELSE to_months(CAST(event_id % 30 AS INTEGER)) END AS start FROM events""",
)
def _relative(spark, sf):
    events = table(spark, sf, "events")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("hour", "day", "week", "month")]), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select("event_id", back_from(newest(spark, sf), (F.col("event_id") % 30).cast("int"), unit).alias("start"))


# --- from question texts to rows ----------------------------------------------

_ASKED = cte("auth_logs", "anomalies", "rules", "asked") + f""", w AS (SELECT q.question_id, q.form, q.most, q.ip, l.* FROM asked q JOIN auth_logs l
    ON l.timestamp >= {_NOW} - to_days(CAST(q.days AS INTEGER)) AND l.timestamp <= {_NOW})"""
_SHOWN = "question_id, kind, id, count, entity_name, source, event_category, data_type, event_time, description"
_ANSWERS = {
    "login_failures": """SELECT question_id, 'login_failures' AS kind, CAST(NULL AS BIGINT) AS id, count(*) AS count, "user" AS entity_name, source_ip AS source, 'login_failure' AS event_category,
        'count' AS data_type, max(timestamp) AS event_time, CAST(NULL AS VARCHAR) AS description FROM w WHERE form = 0 AND event_type = 'login' AND message ILIKE '%failure%' GROUP BY question_id, "user", source_ip""",
    "anomalies": """SELECT question_id, 'anomalies' AS kind, anomaly_id AS id, CAST(NULL AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS entity_name, source_ip AS source, anomaly_type AS event_category,
        'anomaly' AS data_type, timestamp AS event_time, message AS description FROM w JOIN anomalies a ON w.log_id = a.log_id WHERE form IN (1, 4)""",
    "rules": """SELECT question_id, 'rules' AS kind, rule_id AS id, CAST(NULL AS BIGINT) AS count, name AS entity_name, '' AS source, action AS event_category,
        'rule' AS data_type, created_at AS event_time, CAST(NULL AS VARCHAR) AS description FROM asked, rules WHERE form = 2""",
    "logs": """SELECT question_id, 'logs' AS kind, log_id AS id, CAST(NULL AS BIGINT) AS count, CAST(NULL AS VARCHAR) AS entity_name, source_ip AS source, event_type AS event_category,
        'log' AS data_type, timestamp AS event_time, message AS description FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY timestamp DESC, log_id) AS place FROM w
        WHERE form = 4 OR (form = 3 AND (source_ip ILIKE ip OR message ILIKE '%' || ip || '%'))) WHERE place <= CASE form WHEN 3 THEN most ELSE 100 END""",
}


def _answered(spark, sf):
    tables = [view(spark, sf, n) for n in ("auth_logs", "anomalies", "rules")]
    return answer_questions(view(spark, sf, "asked"), *tables, newest(spark, sf))


for _name, _sql in _ANSWERS.items():

    @query(f"answered_{_name}", f"{_ASKED} {_sql}")
    def _answers(spark, sf, kind=_name):
        return _answered(spark, sf).filter(F.col("kind") == kind)


@query("answered_questions", f"{_ASKED} SELECT {_SHOWN} FROM (" + ") UNION ALL SELECT * FROM (".join(_ANSWERS.values()) + ")")
def _all_answers(spark, sf):
    return _answered(spark, sf)


_SPECIAL = {
    "今天": ("date_trunc('day', ts)", "date_trunc('day', ts) + INTERVAL 86399 SECOND"),
    "昨天": ("date_trunc('day', ts) - INTERVAL 1 DAY", "date_trunc('day', ts) - INTERVAL 1 SECOND"),
    "本周": ("date_trunc('week', ts)", "ts"),
    "上周": ("date_trunc('week', ts) - INTERVAL 7 DAY", "date_trunc('week', ts) - INTERVAL 1 SECOND"),
    "本月": ("date_trunc('month', ts)", "ts"),
    "上个月": ("date_trunc('month', ts) - INTERVAL 1 MONTH", "date_trunc('month', ts) - INTERVAL 1 SECOND"),
}


@query(
    "calendar_ranges",
    " UNION ALL ".join(f"SELECT event_id, '{p}' AS phrase, CAST({a} AS TIMESTAMP) AS start, CAST({b} AS TIMESTAMP) AS \"end\" FROM events" for p, (a, b) in _SPECIAL.items()),
)
def _calendar(spark, sf):
    phrases = table(spark, sf, "events").select("event_id", "ts", F.explode(F.array(*[F.lit(p) for p in _SPECIAL])).alias("phrase"))
    return phrases.withColumn("_r", calendar_range(F.col("phrase"), F.col("ts"))).select("event_id", "phrase", "_r.start", "_r.end")


_PRINTED = [
    ("%Y-%m-%d", "yyyy-MM-dd", "day"), ("%Y/%m/%d", "yyyy/MM/dd", "day"), ("%Y年%m月%d日", "yyyy年MM月dd日", "day"),
    ("%Y-%m-%d %H:%M", "yyyy-MM-dd HH:mm", "minute"), ("%Y/%m/%d %H:%M", "yyyy/MM/dd HH:mm", "minute"), ("%Y年%m月%d日 %H:%M", "yyyy年MM月dd日 HH:mm", "minute"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-MM-dd HH:mm:ss", "second"), ("%Y/%m/%d %H:%M:%S", "yyyy/MM/dd HH:mm:ss", "second"), ("%Y年%m月%d日 %H:%M:%S", "yyyy年MM月dd日 HH:mm:ss", "second"),
]


@query(
    "parsed_dates",
    "SELECT event_id, CASE event_id % 11 "
    + " ".join(f"WHEN {i} THEN CAST(date_trunc('{unit}', ts) AS TIMESTAMP)" for i, (_, _, unit) in enumerate(_PRINTED))
    + " WHEN 9 THEN make_timestamp(1900, month(ts), day(ts), hour(ts), minute(ts), 0.0) END AS parsed FROM events",
)
def _dates(spark, sf):
    printed = None
    which = F.col("event_id") % 11
    for i, (_, fmt, _) in enumerate(_PRINTED):
        value = F.date_format("ts", fmt)
        printed = F.when(which == i, value) if printed is None else printed.when(which == i, value)
    printed = printed.when(which == 9, F.date_format("ts", "MM月dd日 HH:mm")).otherwise("no date")
    return table(spark, sf, "events").select("event_id", parse_date(printed).alias("parsed"))
