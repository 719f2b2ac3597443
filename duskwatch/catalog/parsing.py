"""Readers and parsers as registered queries.

The lines are printed from the derived log tables; the SQL states the fields
they were printed from, so each check is a round trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.catalog.registry import query
from duskwatch.catalog.views import _IP, cte, table, view
from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.text import clean, tokens
from duskwatch.plans.ordering import freeze
from duskwatch.session import new_folder
from duskwatch.sources import parsers as P
from duskwatch.sources import readers as D

_ADDRESS = _IP.replace("{div}", "//")


def _lines(spark, sf, kind):
    """Printed lines as stored data, as a parser would meet them."""
    return freeze(view(spark, sf, f"raw_{kind}"))


@query(
    "parsed_ssh_lines",
    f"""SELECT event_id, make_timestamp(2024, 12, 1 + event_id % 28, 9, 32, CAST(event_id % 60 AS DOUBLE)) AS timestamp,
    CAST(event_id % 32768 AS INT) AS process_id,
    CASE event_id % 7 WHEN 0 THEN 'authentication_failure' WHEN 1 THEN 'authentication_failure' WHEN 2 THEN 'invalid_user' WHEN 3 THEN 'connection_closed'
      WHEN 4 THEN 'reverse_dns_failure' WHEN 5 THEN 'login_success' ELSE CASE WHEN event_id % 2 = 0 THEN 'port_forward' ELSE 'other' END END AS event_type,
    CASE WHEN event_id % 7 IN (0, 1, 2, 5) THEN 'u' || CAST(event_id % 9 AS VARCHAR) END AS "user",
    CASE WHEN event_id % 7 < 6 THEN {_ADDRESS} END AS source_ip,
    CASE WHEN event_id % 7 IN (0, 1, 5) THEN CAST(1024 + event_id % 50000 AS INT) ELSE -1 END AS port,
    CASE WHEN event_id % 7 = 4 THEN '{fixed.REASON_PARSED_REVERSE_DNS}' END AS reason,
    CASE WHEN event_id % 7 = 6 AND event_id % 2 = 0 THEN CAST(event_id % 1000 AS VARCHAR) || '->db.local:3306' END AS forwarded_ports,
    CASE WHEN event_id % 7 = 6 AND event_id % 2 = 1 THEN 'Server listening on 0.0.0.0' END AS raw_message
    FROM events WHERE event_id % 101 <> 0""",
)
def _ssh(spark, sf):
    parsed = P.parse(_lines(spark, sf, "ssh"), "ssh", "DROPMALFORMED")
    return parsed.drop("line", "message").fillna(-1, ["port"])


@query(
    "parsed_ssh_with_country",
    cte("geo_ranges")
    + f"""SELECT event_id, coalesce(country, 'UNKNOWN') AS country_code FROM events LEFT JOIN geo_ranges ON
      (10 * 16777216 + (user_id // 65536 % 256) * 65536 + (user_id // 256 % 256) * 256 + user_id % 256) BETWEEN ip_start AND ip_end
    WHERE event_id % 101 <> 0 AND event_id % 7 = 5""",
)
def _ssh_country(spark, sf):
    parsed = P.parse(_lines(spark, sf, "ssh"), "ssh", "DROPMALFORMED")
    located = P.add_login_country(parsed, view(spark, sf, "geo_ranges"))
    return located.filter("country_code IS NOT NULL").select("event_id", "country_code")


@query(
    "parsed_web_lines",
    cte("web_logs")
    + """SELECT id AS event_id, source_ip, make_timestamp(2023, 4, 1 + id % 28, 14, 15, 16.0) AS timestamp, method, path, status_code,
    id % 5000 AS bytes_sent, 'https://example.com' AS referrer, user_agent FROM web_logs WHERE id % 101 <> 0""",
)
def _web(spark, sf):
    return P.parse(_lines(spark, sf, "web"), "web", "DROPMALFORMED").drop("line")


@query(
    "parsed_firewall_lines",
    cte("firewall_logs")
    + """SELECT id AS event_id, make_timestamp(2024, 3, 10 + id % 18, 12, 34, 56.0) AS timestamp, CASE WHEN action = 'DROP' THEN 'DROP' ELSE 'ALLOW' END AS action,
    'eth0' AS in_interface, CAST(NULL AS VARCHAR) AS out_interface, source_ip, dest_ip, protocol, src_port, dest_port FROM firewall_logs WHERE id % 101 <> 0""",
)
def _firewall(spark, sf):
    return P.parse(_lines(spark, sf, "firewall"), "firewall", "DROPMALFORMED").drop("line")


@query(
    "parsed_mysql_lines",
    cte("mysql_logs")
    + """SELECT id AS event_id, TIMESTAMP '2025-03-24 12:34:56.123456' AS timestamp,
    CASE id % 5 WHEN 1 THEN 'Query' WHEN 3 THEN 'Warning' ELSE 'Note' END AS log_kind,
    CASE WHEN id % 5 = 0 THEN "user" END AS "user", CASE WHEN id % 5 = 0 THEN source_ip END AS source_ip,
    CASE WHEN id % 5 IN (1, 2) THEN sql_statement END AS sql_statement, CASE WHEN id % 5 = 3 THEN id % 90 + 0.5::DOUBLE END AS duration,
    CASE WHEN id % 5 = 0 THEN 'auth_failure' WHEN id % 5 IN (1, 2) AND sql_statement LIKE 'DROP TABLE%' THEN 'high_risk_operation'
      ELSE CASE id % 5 WHEN 1 THEN 'Query' WHEN 3 THEN 'Warning' ELSE 'Note' END END AS event_type
    FROM mysql_logs WHERE id % 101 <> 0""",
)
def _mysql(spark, sf):
    return P.parse(_lines(spark, sf, "mysql"), "mysql", "DROPMALFORMED").drop("line", "message")


@query(
    "parsed_hdfs_lines",
    cte("hdfs_logs")
    + """SELECT id AS event_id, make_timestamp(2008, 11, 10 + id % 18, 20, 49, CAST(10 + id % 50 AS DOUBLE)) AS timestamp, pid, level, component, content, Eventid,
    CASE id % 14 WHEN 0 THEN 'blk_' || id || '|/' || ip WHEN 1 THEN 'blk_' || id || '|' || ip || ':50010'
      WHEN 2 THEN ip || ':50010|blk_' || id || '|/' || ip WHEN 3 THEN ip || ':50010|blk_' || id WHEN 4 THEN ip || ':50010|blk_' || id || '|' || ip || ':50011'
      WHEN 5 THEN ip || ':50010|blk_' || id || '|67108864' WHEN 6 THEN '/user/job/part-' || id || '|blk_' || id WHEN 7 THEN 'blk_' || id || '|' || ip || ':50010'
      WHEN 8 THEN 'blk_' || id || '|/mnt/dfs/blk_' || id WHEN 9 THEN '1|blk_' || id WHEN 10 THEN 'blk_' || id || '|67108864|/' || ip
      WHEN 11 THEN 'blk_' || id || '|/' || ip || ':50010|/' || ip || ':50011|9' WHEN 12 THEN 'blk_' || id || '|/' || ip || ':50010|/' || ip || ':50011'
      ELSE 'blk_' || id END AS details
    FROM (SELECT *, concat('10.', CAST(pid // 65536 % 256 AS STRING), '.', CAST(pid // 256 % 256 AS STRING), '.', CAST(pid % 256 AS STRING)) AS ip FROM hdfs_logs) WHERE id % 101 <> 0""",
)
def _hdfs(spark, sf):
    parsed = P.parse(_lines(spark, sf, "hdfs"), "hdfs", "DROPMALFORMED")
    return parsed.withColumn("details", F.array_join("details", "|")).drop("line")


@query(
    "parsed_linux_lines",
    f"""SELECT event_id, 'Jun' AS month, CAST(10 + event_id % 18 AS INT) AS date, '15:16:01' AS time, 'combo' AS level, 'combo' AS host, 'sshd(pam_unix)' AS component,
    CAST(event_id % 30000 AS INT) AS pid, make_timestamp(2024, 6, 10 + event_id % 18, 15, 16, 1.0) AS timestamp,
    CASE WHEN event_id % 5 = 0 THEN '' END AS logname, CASE WHEN event_id % 5 = 0 THEN '0' END AS uid, CASE WHEN event_id % 5 = 0 THEN '0' END AS euid,
    CASE WHEN event_id % 5 = 0 THEN 'NODEVssh' END AS tty, CASE WHEN event_id % 5 = 0 THEN '' END AS ruser, CASE WHEN event_id % 5 = 0 THEN {_ADDRESS} END AS source_ip,
    CASE WHEN event_id % 5 = 0 THEN 'root' END AS "user",
    CASE event_id % 5 WHEN 0 THEN 'authentication_failure' WHEN 3 THEN 'connection_closed' WHEN 4 THEN 'other' ELSE 'password_check' END AS event_type,
    CASE event_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'false' WHEN 2 THEN 'true' ELSE 'unset' END AS success
    FROM events WHERE event_id % 101 <> 0""",
)
def _linux(spark, sf):
    return P.parse(_lines(spark, sf, "linux"), "linux", "DROPMALFORMED").drop("line", "content").withColumn(
        "success", F.coalesce(F.col("success").cast("string"), F.lit("unset"))
    )


for _kind in ("ssh", "web", "firewall", "mysql", "hdfs", "linux"):

    @query(
        f"ingest_summary_{_kind}",
        "SELECT count(*) AS lines, count(*) FILTER (event_id % 101 <> 0) AS valid, count(*) FILTER (event_id % 101 = 0) AS malformed FROM events",
    )
    def _summary(spark, sf, kind=_kind):
        """Lines written to a file and read back, malformed ones kept and counted."""
        folder = new_folder(spark, f"lines-{kind}")
        _lines(spark, sf, kind).select("line").write.text(folder)
        return P.ingest_summary(D.read_logs(spark, folder, kind))


@query(
    "malformed_lines_kept",
    cte("raw_hdfs") + "SELECT event_id, line AS _corrupt_record FROM raw_hdfs WHERE line = 'garbage line'",
)
def _kept(spark, sf):
    return P.parse(_lines(spark, sf, "hdfs"), "hdfs").filter("_corrupt_record IS NOT NULL").select("event_id", "_corrupt_record")


@query(
    "csv_export_rows",
    cte("logs")
    + "SELECT '2023-01-01' AS timestamp, source_ip, CASE WHEN log_id % 2 = 0 THEN event_type ELSE '' END AS event_type, message FROM logs",
)
def _csv(spark, sf):
    folder = new_folder(spark, "csv")
    parts = _lines(spark, sf, "csv").select(
        *[F.split_part("line", F.lit(","), F.lit(i + 1)).alias(n) for i, n in enumerate(["timestamp", "ip", "source_ip", "event"])],
        F.regexp_extract("line", r'"(.*)"$', 1).alias("message"),
    )
    parts.write.option("header", True).csv(folder)
    return D.read_csv(spark, folder).drop("raw_log")


@query(
    "txt_export_rows",
    cte("logs", "raw_txt")
    + """SELECT '2023-01-01 12:00:' || CAST(10 + l.log_id % 50 AS VARCHAR) AS timestamp, CASE WHEN event_type = 'failed_login' THEN 'WARN' ELSE 'INFO' END AS event_type,
    source_ip, message, line AS raw_log FROM logs l JOIN raw_txt r ON l.log_id = r.event_id WHERE l.log_id % 101 <> 0""",
)
def _txt(spark, sf):
    folder = new_folder(spark, "txt")
    _lines(spark, sf, "txt").select("line").write.text(folder)
    return D.read_txt(spark, folder)


@query(
    "jsonl_export_rows",
    cte("logs")
    + """SELECT log_id AS event_id, CASE WHEN log_id % 2 = 0 THEN '2023-01-01 00:00:00' ELSE '2023-01-02 00:00:00' END AS timestamp, source_ip, event_type,
    CASE WHEN log_id % 2 = 0 THEN message ELSE '' END AS message FROM logs WHERE log_id % 101 <> 0""",
)
def _jsonl(spark, sf):
    return P.parse_jsonl(_lines(spark, sf, "jsonl")).drop("line", "raw_log")


@query(
    "labelled_rows",
    "SELECT event_id, event_type || ' event ' || CAST(event_id AS VARCHAR) AS text, CAST(event_type = 'error' AS INT) AS label FROM events WHERE event_id % 101 <> 0",
)
def _labelled(spark, sf):
    return D.parse_labelled(_lines(spark, sf, "labelled"))


@query("non_blank_document_lines", r"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> '' GROUP BY ALL")
def _blank(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return D.non_blank(lines).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query("sequence_file_lines")
def _sequence_file(spark, sf):
    """Lines written to text files and read back with their positions."""
    folder = new_folder(spark, "sequence")
    view(spark, sf, "logs").select("message").write.text(folder)
    return D.read_sequence(spark, folder).select("idx", "line")


@query("table_scan", "SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
def _scan(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("count"))


_KINDS = ["ssh", "web", "firewall", "mysql", "hdfs", "linux"]


@query(
    "detected_log_types",
    " UNION ALL ".join(
        f"SELECT '{k}' AS printed, CASE WHEN event_id % 101 <> 0 THEN '{k}' END AS log_type, count(*) AS count FROM events GROUP BY ALL" for k in _KINDS
    ),
)
def _detected(spark, sf):
    out = None
    for kind in _KINDS:
        lines = _lines(spark, sf, kind).select(F.lit(kind).alias("printed"), "line")
        out = lines if out is None else out.unionByName(lines)
    return P.detect_log_type(out).groupBy("printed", "log_type").agg(F.count(F.lit(1)).alias("count"))


_TIMED = """SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx, event_id, ts,
    CASE WHEN event_id % 7 = 0 THEN 'no time' WHEN user_id % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' x' WHEN user_id % 4 = 1 THEN strftime(ts, '%Y/%m/%d') || ' x'
    WHEN user_id % 4 = 2 THEN 'never' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z x' END AS line FROM events"""


@query(
    "detected_timestamps",
    f"""WITH lines AS ({_TIMED}), pat AS (SELECT *, regexp_matches(line, '\\d{{4}}-\\d{{2}}-\\d{{2}}T') AS iso, regexp_matches(line, '\\d{{4}}-\\d{{2}}-\\d{{2}} ') AS std, regexp_matches(line, '\\d{{4}}/\\d{{2}}/\\d{{2}}') AS sl FROM lines),
    vote AS (SELECT seq_id, CASE WHEN count(*) FILTER (iso) >= count(*) / 2 THEN 'iso' WHEN count(*) FILTER (std) >= count(*) / 2 THEN 'std' WHEN count(*) FILTER (sl) >= count(*) / 2 THEN 'sl' END AS kind FROM pat GROUP BY ALL),
    rd AS (SELECT p.seq_id, idx, CASE WHEN kind = 'iso' AND iso THEN date_trunc('second', ts) WHEN kind = 'std' AND std THEN date_trunc('second', ts) WHEN kind = 'sl' AND sl THEN date_trunc('day', ts) END AS t FROM pat p JOIN vote v ON p.seq_id = v.seq_id),
    ok AS (SELECT *, CASE WHEN count(t) OVER (PARTITION BY seq_id) >= count(*) OVER (PARTITION BY seq_id) * 0.5 THEN t END AS t2 FROM rd)
    SELECT seq_id, idx, CAST(coalesce(last_value(t2 IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY idx ROWS UNBOUNDED PRECEDING),
      first_value(t2 IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS TIMESTAMP) AS ts FROM ok""",
)
def _timestamps(spark, sf):
    from duskwatch.plans.ordering import row_index

    events = table(spark, sf, "events").withColumn("seq_id", F.col("user_id"))
    sort = F.col("user_id") % 4
    text = (
        F.when(F.col("event_id") % 7 == 0, "no time")
        .when(sort == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" x")))
        .when(sort == 1, F.concat(F.date_format("ts", "yyyy/MM/dd"), F.lit(" x")))
        .when(sort == 2, "never")
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z x")))
    )
    lines = row_index(events, ["ts", "event_id"], ["seq_id"]).select("seq_id", "idx", text.alias("line"))
    return D.detect_timestamps(lines).select("seq_id", "idx", "ts")


_CLEAN = r"""lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(message, '\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}.\d{3}', '', 'g'),
    '\b(INFO|DEBUG|ERROR|WARNING|WARN|TRACE)\b', '', 'g'), '\s+', ' ', 'g')), '[^a-zA-Z0-9\s]', '', 'g'))"""


@query("cleaned_messages", cte("logs") + f"SELECT log_id, {_CLEAN} AS cleaned FROM logs")
def _cleaned(spark, sf):
    return view(spark, sf, "logs").select("log_id", clean("message").alias("cleaned"))


@query(
    "message_tokens",
    cte("logs") + rf"SELECT log_id, list_aggregate(list_filter(string_split_regex({_CLEAN}, '\s+'), lambda t: t <> ''), 'string_agg', '|') AS words FROM logs",
)
def _tokens(spark, sf):
    return view(spark, sf, "logs").select("log_id", F.array_join(tokens("message"), "|").alias("words"))
