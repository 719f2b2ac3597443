"""Raw log lines to typed columns, one parser per log type.

Parsers only add columns, so they run the same on batch tables and on streams,
stay inside code generation and keep every other column of their input. A field
whose pattern misses is null; a line whose header misses is malformed and is
handled by the ``mode`` of ``parse``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.text import extract
from duskwatch.operators.geo import with_country

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
_WORDS = "(?U)"  # word classes over all of Unicode, for names


def _local(text: Column, fmt: str) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def _utc(text: Column, fmt: str) -> Column:
    """Parse a time that names its zone; the result is its UTC wall clock."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _local(text, fmt))


def _dated(text: Column, year: int) -> Column:
    """``MMM d HH:mm:ss`` with the year the line leaves out."""
    tidy = F.regexp_replace(text, r"\s+", " ")
    return _local(F.concat(F.lit(f"{year} "), tidy), "yyyy MMM d HH:mm:ss")


def _record(fields: dict[str, str], **given: Column) -> Column:
    """A struct of all ``fields`` (name to type), null where not given."""
    return F.struct(
        *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()]
    )


def _first_case(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The record of the first condition that holds.

    One conditional yields the whole record, so each pattern is evaluated once
    however many of its fields a query uses.
    """
    chain = F.when(*cases[0])
    for condition, record in cases[1:]:
        chain = chain.when(condition, record)
    return chain if otherwise is None else chain.otherwise(otherwise)


_SSH_FIELDS = {
    "event_type": "string", "user": "string", "source_ip": "string", "port": "int",
    "reason": "string", "forwarded_ports": "string", "raw_message": "string",
}


def parse_ssh(lines: DataFrame, year: int, column: str = "line") -> DataFrame:
    head = lines.withColumns(
        {
            "matched": F.col(column).rlike(fixed.SSH_HEADER),
            "timestamp": _dated(F.regexp_extract(column, fixed.SSH_HEADER, 1), year),
            "process_id": extract(column, fixed.SSH_HEADER, 2).try_cast("int"),
            "message": F.regexp_extract(column, fixed.SSH_HEADER, 3),
        }
    )
    text = F.col("message")

    def has(phrase: str) -> Column:
        return F.contains(text, F.lit(phrase))

    def event(name: str, **given: Column) -> Column:
        return _record(_SSH_FIELDS, event_type=F.lit(name), **given)

    from_ip = extract(text, rf"from ({fixed.IPV4})")
    any_port = extract(text, r"port (\d+)").try_cast("int")
    forward = r"port (\d+)->(.+):(\d+)"
    cases = [
        (~F.col("matched"), _record(_SSH_FIELDS)),
        (
            has("Failed password"),
            event(
                "authentication_failure",
                user=extract(text, _WORDS + r"for( invalid user)? (\w+)", 2), source_ip=from_ip, port=any_port,
            ),
        ),
        (
            has("Invalid user") & text.rlike(_WORDS + r"Invalid user (\w+)"),
            event("invalid_user", user=extract(text, _WORDS + r"Invalid user (\w+)"), source_ip=from_ip),
        ),
        (has("Connection closed"), event("connection_closed", source_ip=extract(text, rf"by ({fixed.IPV4})"))),
        (
            has("reverse mapping checking getaddrinfo")
            & has("POSSIBLE BREAK-IN ATTEMPT")
            & text.rlike(rf"\[{fixed.IPV4}\]"),
            event(
                "reverse_dns_failure",
                source_ip=extract(text, rf"\[({fixed.IPV4})\]"), reason=F.lit(fixed.REASON_PARSED_REVERSE_DNS),
            ),
        ),
        (
            has("Accepted password"),
            event("login_success", user=extract(text, _WORDS + r"for (\w+)"), source_ip=from_ip, port=any_port),
        ),
        (
            has("forwarding") & text.rlike(forward),
            event(
                "port_forward",
                forwarded_ports=F.format_string("%s->%s:%s", *[F.regexp_extract(text, forward, g) for g in (1, 2, 3)]),
            ),
        ),
    ]
    found = head.withColumn("_found", _first_case(cases, event("other", raw_message=text)))
    return found.select("*", *[F.col(f"_found.{c}").alias(c) for c in _SSH_FIELDS]).drop("_found")


def add_login_country(parsed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Country of successful logins, UNKNOWN outside every range, null otherwise."""
    located = with_country(parsed, ranges, "source_ip")
    return located.withColumn(
        "country_code", F.when(F.col("event_type") == "login_success", F.col("country"))
    ).drop("country")


def parse_web(lines: DataFrame, column: str = "line") -> DataFrame:
    def group(number: int) -> Column:
        return F.regexp_extract(column, fixed.WEB_COMBINED, number)

    matched = F.col(column).rlike(fixed.WEB_COMBINED)
    return lines.withColumns(
        {
            "matched": matched,
            "source_ip": F.nullif(group(1), F.lit("")),
            "timestamp": _utc(group(2), "dd/MMM/yyyy:HH:mm:ss Z"),
            "method": F.nullif(group(3), F.lit("")),
            "path": F.when(matched, group(4)),
            "status_code": group(5).try_cast("int"),
            "bytes_sent": group(6).try_cast("long"),
            "referrer": F.when(matched, group(7)),
            "user_agent": F.when(matched, group(8)),
        }
    )


def parse_firewall(lines: DataFrame, year: int, column: str = "line") -> DataFrame:
    def group(number: int) -> Column:
        return extract(column, fixed.FIREWALL_LINE, number)

    action = group(2)
    return lines.withColumns(
        {
            "matched": F.col(column).rlike(fixed.FIREWALL_LINE),
            "timestamp": _dated(group(1), year),
            "action": F.when(action == "BLOCK", "DROP").otherwise(action),
            "in_interface": group(3),
            "out_interface": group(4),
            "source_ip": group(5),
            "dest_ip": group(6),
            "protocol": group(7),
            "src_port": group(8).try_cast("int"),
            "dest_port": group(9).try_cast("int"),
        }
    )


_MYSQL_FIELDS = {
    "event_type": "string", "user": "string", "source_ip": "string", "sql_statement": "string", "duration": "double",
}


def parse_mysql(lines: DataFrame, column: str = "line") -> DataFrame:
    head = lines.withColumns(
        {
            "matched": F.col(column).rlike(fixed.MYSQL_HEADER),
            "timestamp": _utc(
                F.regexp_extract(column, fixed.MYSQL_HEADER, 1), "yyyy-MM-dd'T'HH:mm:ss.[SSSSSSSSS][SSSSSS][SSS]X"
            ),
            "log_kind": extract(column, fixed.MYSQL_HEADER, 2),
            "message": F.regexp_extract(column, fixed.MYSQL_HEADER, 3),
        }
    )
    text, kind = F.col("message"), F.col("log_kind")
    account = _WORDS + r"user '(\w+)'@'(\S+)'"

    def event(name: Column, **given: Column) -> Column:
        return _record(_MYSQL_FIELDS, event_type=name, **given)

    def with_statement(statement: Column) -> Column:
        risky = statement.ilike(fixed.DROP_TABLE_STATEMENTS[0])
        return event(F.when(risky, "high_risk_operation").otherwise(kind), sql_statement=statement)

    cases = [
        (
            F.contains(text, F.lit("Access denied")),
            event(F.lit("auth_failure"), user=extract(text, account, 1), source_ip=extract(text, account, 2)),
        ),
        (
            F.contains(text, F.lit("Query took")),
            event(kind, duration=extract(text, r"Query took (\d+\.\d+) sec").try_cast("double")),
        ),
        (text.rlike(r"Query:\s+"), with_statement(extract(text, r"Query:\s+(.*)"))),
        (kind == "Query", with_statement(text)),
    ]
    found = head.withColumn("_found", _first_case(cases, event(kind)))
    return found.select("*", *[F.col(f"_found.{c}").alias(c) for c in _MYSQL_FIELDS]).drop("_found")


def parse_hdfs(lines: DataFrame, column: str = "line") -> DataFrame:
    def group(number: int) -> Column:
        return extract(column, fixed.HDFS_HEADER, number)

    stamp = F.concat(F.lit("20"), group(1), group(2), group(3), group(4))
    head = lines.withColumns(
        {
            "matched": F.col(column).rlike(fixed.HDFS_HEADER),
            "timestamp": _local(stamp, "yyyyMMddHHmmss"),
            "pid": group(5).try_cast("int"),
            "level": group(6),
            "component": F.when(F.col(column).rlike(fixed.HDFS_HEADER), F.regexp_extract(column, fixed.HDFS_HEADER, 7)),
            "content": F.when(F.col(column).rlike(fixed.HDFS_HEADER), F.regexp_extract(column, fixed.HDFS_HEADER, 8)),
        }
    )
    text = F.col("content")
    cases = [
        (
            text.rlike("^" + pattern),
            F.struct(
                F.lit(name).alias("Eventid"),
                F.array(
                    *[F.regexp_extract(text, "^" + pattern, g + 1) for g in range(pattern.count(r"(\S+)"))]
                ).alias("details"),
            ),
        )
        for name, pattern in fixed.HDFS_TEMPLATES.items()
    ]
    found = head.withColumn("_found", _first_case(cases))
    return found.select("*", "_found.Eventid", "_found.details").drop("_found")


def parse_linux(lines: DataFrame, year: int, column: str = "line") -> DataFrame:
    def group(number: int) -> Column:
        return extract(column, fixed.LINUX_HEADER, number)

    head = lines.withColumns(
        {
            "matched": F.col(column).rlike(fixed.LINUX_HEADER),
            "month": group(1),
            "date": group(2).try_cast("int"),
            "time": group(3),
            "level": group(4),
            "host": group(4),
            "component": group(5),
            "pid": group(6).try_cast("int"),
            "content": group(7),
        }
    )
    text = F.col("content")
    keys = {
        ("source_ip" if key == "rhost" else key): F.when(
            text.rlike(rf"\b{key}="), F.regexp_extract(text, rf"\b{key}=(\S*)", 1)
        )
        for key in fixed.LINUX_KEYS
    }
    failed, checked, closed = (
        F.contains(text, F.lit(p)) for p in ("authentication failure", "check pass", "Connection closed")
    )
    return head.withColumns(
        {
            "timestamp": _dated(F.concat_ws(" ", "month", F.col("date").cast("string"), "time"), year),
            **keys,
            "event_type": F.when(failed, "authentication_failure")
            .when(checked, "password_check")
            .when(closed, "connection_closed")
            .when(text.isNotNull(), "other"),
            "success": F.when(failed, False).when(checked, ~F.contains(text, F.lit("user unknown"))),
        }
    )


def parse_txt(lines: DataFrame, column: str = "line") -> DataFrame:
    """``ts [LEVEL] ip - message`` lines; others are dropped."""
    matching = lines.filter(F.col(column).rlike(fixed.TXT_LINE))
    return matching.withColumns(
        {
            "timestamp": F.regexp_extract(column, fixed.TXT_LINE, 1),
            "event_type": F.regexp_extract(column, fixed.TXT_LINE, 2),
            "source_ip": F.regexp_extract(column, fixed.TXT_LINE, 3),
            "message": F.regexp_extract(column, fixed.TXT_LINE, 4),
            "raw_log": F.col(column),
        }
    )


def parse_jsonl(lines: DataFrame, column: str = "line") -> DataFrame:
    """JSON-lines records with alias names; lines that are not JSON objects are dropped."""
    names = ["time", "timestamp", "ip", "source_ip", "event", "event_type", "message"]
    schema = ", ".join(f"{n} STRING" for n in names) + ", _corrupt STRING"
    record = F.from_json(F.col(column), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    opened = lines.withColumn("_r", record).filter(F.col("_r").isNotNull() & F.col("_r._corrupt").isNull())

    def first(short: str, long: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"_r.{short}"), F.lit("")), F.col(f"_r.{long}"), F.lit(""))

    return opened.withColumns(
        {
            "timestamp": first("time", "timestamp"),
            "source_ip": first("ip", "source_ip"),
            "event_type": first("event", "event_type"),
            "message": F.coalesce("_r.message", F.lit("")),
            "raw_log": F.col(column),
        }
    ).drop("_r")


def parse(lines: DataFrame, log_type: str, mode: str = "PERMISSIVE", year: int = 2024, column: str = "line") -> DataFrame:
    """Parse lines of a log type.

    PERMISSIVE keeps malformed lines with ``_corrupt_record`` set, DROPMALFORMED
    drops them, FAILFAST fails the job with the message for that log type.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    parsers = {
        "ssh": lambda: parse_ssh(lines, year, column),
        "web": lambda: parse_web(lines, column),
        "firewall": lambda: parse_firewall(lines, year, column),
        "mysql": lambda: parse_mysql(lines, column),
        "hdfs": lambda: parse_hdfs(lines, column),
        "linux": lambda: parse_linux(lines, year, column),
    }
    if log_type not in parsers:
        raise ValueError("Unsupported log type")
    parsed = parsers[log_type]()
    if mode == "DROPMALFORMED":
        return parsed.filter("matched").drop("matched")
    if mode == "FAILFAST":
        message = F.concat(F.lit(fixed.INVALID_LINE_MESSAGES[log_type] + ": "), F.col(column))
        guarded = F.when(F.col("matched"), F.col(column)).otherwise(F.raise_error(message).cast("string"))
        return parsed.withColumn(column, guarded).filter(F.col(column).isNotNull()).drop("matched")
    return parsed.withColumn("_corrupt_record", F.when(~F.col("matched"), F.col(column))).drop("matched")


def ingest_summary(parsed: DataFrame) -> DataFrame:
    """Line, valid and malformed counts of a PERMISSIVE parse."""
    bad = F.col("_corrupt_record").isNotNull()
    return parsed.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("malformed")
    )


def detect_log_type(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add ``log_type``: the first format whose pattern the line fits, else null."""
    text = F.col(column)
    kind = (
        F.when(text.rlike(fixed.WEB_COMBINED), "web")
        .when(text.rlike(fixed.FIREWALL_LINE), "firewall")
        .when(text.rlike(fixed.MYSQL_HEADER), "mysql")
        .when(text.rlike(fixed.LINUX_HEADER), "linux")
        .when(text.rlike(fixed.SSH_HEADER), "ssh")
        .when(text.rlike(fixed.HDFS_HEADER), "hdfs")
    )
    return lines.withColumn("log_type", kind)
