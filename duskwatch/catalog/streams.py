"""Streaming forms as registered queries: read all files of the table once, return the stored result.

A window is final when the watermark, the newest time of the rows the rule
looks at minus the delay, has passed its end; the SQL states the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.catalog.detection import FLAGGED
from duskwatch.catalog.registry import query, rounded
from duskwatch.catalog.views import VIEWS, _point, cte, table, view
from duskwatch.functions.predicates import moment
from duskwatch.functions.timecols import as_wall_clock
from duskwatch.operators import rules as R
from duskwatch.plans.ordering import freeze
from duskwatch.session import new_folder
from duskwatch.sources import readers
from duskwatch.streaming import detect as D
from duskwatch.streaming.state import latest


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _stream(spark, sf, name):
    """A derived view over the events as a stream."""
    text = VIEWS[name][1].format(q="`", ntz="TIMESTAMP_NTZ", div="DIV", mon="Dec").replace("{", "{{").replace("}", "}}")
    return spark.sql(_point(text, "events"), events=_events(spark, sf))


def _stored(spark, stream, name):
    folder = new_folder(spark, name)
    D.run_to_table(stream, folder)
    return spark.read.schema(stream.schema).parquet(folder)


def _zone_free(df, *columns):
    return df.withColumns({c: as_wall_clock(c) for c in columns})


def _windows_sql(source, where, keys, measure, metric, name, threshold):
    picked = "".join(f'"{k}", ' for k in keys)
    return (
        cte(source)
        + f", f AS (SELECT * FROM {source} WHERE {where}), w AS (SELECT {picked}date_trunc('day', timestamp) AS day, {measure} AS {metric} FROM f GROUP BY {picked}date_trunc('day', timestamp)) "
        f"SELECT '{name}' AS anomaly_type, {picked}CAST(day AS TIMESTAMP) AS window_start, day + INTERVAL 1 DAY AS window_end, {metric} FROM w "
        f"WHERE {metric} > {threshold} AND day + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM f) - INTERVAL 10 MINUTE"
    )


_WINDOWED = {
    "ssh_brute_force": (R.SSH_BRUTE_FORCE, "ssh_logs", "event_type IN ('authentication_failure', 'invalid_user')", 3),
    "ssh_reverse_dns_failure": (R.SSH_REVERSE_DNS, "ssh_logs", "event_type = 'reverse_dns_failure'", 2),
    "ssh_high_frequency": (R.SSH_HIGH_FREQUENCY, "ssh_logs", "TRUE", 5),
    "ssh_user_enumeration": (R.SSH_USER_ENUMERATION, "ssh_logs", "event_type = 'invalid_user'", 1),
    "ssh_distinct_ports": (R.SSH_DISTINCT_PORTS, "ssh_attempts", "event_type IN ('connection_attempt', 'invalid_port')", 1),
    "ssh_global_ddos": (R.SSH_GLOBAL_DDOS, "ssh_logs", "event_type = 'invalid_user'", 60),
    "web_brute_force": (R.WEB_BRUTE_FORCE, "web_logs", "status_code IN (401, 403)", 1),
    "web_scanner": (R.WEB_SCANNER, "web_logs", "status_code = 404", 1),
    "web_high_frequency": (R.WEB_HIGH_FREQUENCY, "web_logs", "TRUE", 1),
    "firewall_port_scan": (R.FIREWALL_PORT_SCAN, "firewall_logs", "action = 'DROP'", 2),
    "firewall_ddos": (R.FIREWALL_DDOS, "firewall_logs", "protocol = 'TCP' AND dest_port = 80 AND action = 'DROP'", 0),
    "mysql_brute_force": (R.MYSQL_BRUTE_FORCE, "mysql_logs", "event_type = 'auth_failure'", 2),
    "hdfs_service_brute_force": (R.HDFS_SERVICE, "hdfs_logs", "Eventid = 'E3'", 3),
    "hdfs_abnormal_deletions": (R.HDFS_DELETIONS, "hdfs_logs", "Eventid IN ('E4', 'E8')", 1),
    "hdfs_transmission_failures": (R.HDFS_TRANSMISSION, "hdfs_logs", "Eventid = 'E10'", 5),
}


def _register_windowed(name, rule, source, where, threshold):
    measure = f'count(DISTINCT "{rule.distinct}")' if rule.distinct else "count(*)"

    @query(f"stream_{name}", _windows_sql(source, where, rule.keys, measure, rule.metric, rule.name, threshold))
    def run(spark, sf):
        found = D.windowed_rule(_stream(spark, sf, source), rule.tuned(threshold=threshold), duration="1 day")
        return _zone_free(_stored(spark, found, name), "window_start", "window_end")


for _name, _spec in _WINDOWED.items():
    _register_windowed(_name, *_spec)


for _name, (_rule, _source, _where) in FLAGGED.items():

    @query(f"stream_{_name}", cte(_source) + f"SELECT '{_rule.name}' AS anomaly_type, {', '.join(chr(34) + c + chr(34) for c in _rule.columns)} FROM {_source} WHERE {_where}")
    def _pattern(spark, sf, rule=_rule, source=_source):
        return _stored(spark, D.pattern_rule(_stream(spark, sf, source), rule).drop("reason"), rule.name)


@query(
    "stream_geo_anomaly",
    cte("ssh_logs", "geo_ranges")
    + """, f AS (SELECT *, CAST(split_part(source_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(source_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(source_ip, '.', 3) AS BIGINT) * 256
      + CAST(split_part(source_ip, '.', 4) AS BIGINT) AS ip FROM ssh_logs WHERE event_type = 'login_success'),
    d AS (SELECT DISTINCT "user", date_trunc('day', timestamp) AS day, coalesce(country, 'UNKNOWN') AS country FROM f LEFT JOIN geo_ranges ON ip BETWEEN ip_start AND ip_end)
    SELECT "user", day AS window_start, day + INTERVAL 1 DAY AS window_end, string_agg(country, ',' ORDER BY country) AS countries FROM d
    WHERE day + INTERVAL 1 DAY <= (SELECT max(timestamp) FROM f) - INTERVAL 10 MINUTE GROUP BY ALL HAVING count(*) > 1""",
)
def _geo(spark, sf):
    found = D.geo_rule(_stream(spark, sf, "ssh_logs"), view(spark, sf, "geo_ranges"), duration="1 day")
    stored = _stored(spark, found, "geo")
    return _zone_free(stored, "window_start", "window_end").withColumn("countries", F.array_join("countries", ","))


@query("stream_parsed_lines", "SELECT count(*) FILTER (event_id % 101 <> 0) AS parsed, count(*) FILTER (event_id % 101 = 0) AS malformed FROM events")
def _parsed(spark, sf):
    incoming = new_folder(spark, "incoming")
    view(spark, sf, "raw_hdfs").select("line").write.text(incoming)
    stored = _stored(spark, readers.stream_logs(spark, incoming, "hdfs"), "parsed")
    bad = F.col("_corrupt_record").isNotNull()
    return stored.agg(F.count_if(~bad).alias("parsed"), F.count_if(bad).alias("malformed"))


@query("stream_without_duplicates", cte("logs") + "SELECT DISTINCT timestamp, source_ip, message FROM logs")
def _unique(spark, sf):
    """The same files delivered twice; each line is kept once."""
    incoming = new_folder(spark, "twice")
    logs = view(spark, sf, "logs").select("timestamp", "source_ip", "message")
    for _ in range(2):
        logs.write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(logs.schema).parquet(incoming)
    return _zone_free(_stored(spark, D.without_duplicates(stream), "unique"), "timestamp")


@query(
    "stream_running_stats",
    cte("score_series") + "SELECT method, round(min(score), 6) AS min, round(max(score), 6) AS max, round(sum(score), 6) AS sum, count(*) AS count FROM score_series GROUP BY ALL",
)
def _stats(spark, sf):
    """Scores delivered in several files, merged batch by batch."""
    incoming, folder = new_folder(spark, "scores"), new_folder(spark, "stats")
    series = view(spark, sf, "score_series").select("method", "score")
    series.repartition(4).write.parquet(incoming)
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 2).parquet(incoming)
    D.running_stats(stream, folder)
    return latest(spark, folder).select("method", rounded("min"), rounded("max"), rounded("sum"), "count")


@query("stream_recent_bank", "SELECT vec_id AS bank_id FROM embeddings ORDER BY vec_id DESC LIMIT 100")  # a bank of fixed size
def _bank(spark, sf):
    """Vectors delivered in several files; the newest hundred are kept."""
    incoming, folder = new_folder(spark, "vectors"), new_folder(spark, "bank")
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("bank_id"), F.timestamp_seconds("vec_id").alias("ts"), F.col("embedding").alias("vec")
    )
    rows.repartition(4).write.parquet(incoming)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    D.recent_bank(stream, folder, limit=100)
    return latest(spark, folder).select("bank_id")


@query(
    "stream_late_rows",
    cte("ssh_logs")
    + "SELECT source_ip, count(*) AS rows FROM ssh_logs WHERE timestamp < CAST((SELECT max(timestamp) FROM ssh_logs) - INTERVAL 10 DAY AS DATE) GROUP BY ALL",
)
def _late(spark, sf):
    """Old rows arrive after newer ones and are found in the table of late rows; the rule sees the others."""
    incoming, folder = new_folder(spark, "late"), new_folder(spark, "late-sides")
    logs = freeze(view(spark, sf, "ssh_logs"))
    cut = logs.agg(F.to_date(F.max("timestamp") - F.expr("INTERVAL '10' DAY")).cast("timestamp_ntz")).first()[0]
    fresh = F.col("timestamp") >= moment(cut)
    state = new_folder(spark, "late-state")
    day_end = (F.date_trunc("day", "timestamp") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    for part in (fresh, ~fresh):
        logs.filter(part).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(logs.schema).parquet(incoming)
        D.split_late(stream, folder, closes=day_end, checkpoint=state)
    return D.side(spark, folder, "late", logs.schema).groupBy("source_ip").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stream_rule_without_late_rows",
    cte("ssh_logs")
    + f""", n AS (SELECT max(timestamp) AS newest FROM ssh_logs), f AS (SELECT s.* FROM ssh_logs s, n WHERE timestamp >= CAST(newest - INTERVAL 10 DAY AS DATE))
    SELECT '{R.SSH_HIGH_FREQUENCY.name}' AS anomaly_type, source_ip, CAST(date_trunc('day', timestamp) AS TIMESTAMP) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, count(*) AS connections
    FROM f, n WHERE date_trunc('day', timestamp) + INTERVAL 1 DAY <= newest - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def _on_time(spark, sf):
    """A rule over the on-time side counts none of the late rows."""
    incoming, folder = new_folder(spark, "late"), new_folder(spark, "late-sides")
    logs = freeze(view(spark, sf, "ssh_logs"))
    cut = logs.agg(F.to_date(F.max("timestamp") - F.expr("INTERVAL '10' DAY")).cast("timestamp_ntz")).first()[0]
    fresh = F.col("timestamp") >= moment(cut)
    state = new_folder(spark, "late-state")
    day_end = (F.date_trunc("day", "timestamp") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    for part in (fresh, ~fresh):
        logs.filter(part).write.mode("append").parquet(incoming)
        D.split_late(spark.readStream.schema(logs.schema).parquet(incoming), folder, closes=day_end, checkpoint=state)
    rows = spark.readStream.schema(logs.schema).option("recursiveFileLookup", True).parquet(f"{folder}/on-time")
    rule = R.SSH_HIGH_FREQUENCY.tuned(threshold=0)
    return _zone_free(_stored(spark, D.windowed_rule(rows, rule, duration="1 day"), "on-time"), "window_start", "window_end")
