"""Threat rules over log tables.

Two kinds of rule cover the library. A *pattern rule* flags single rows. A
*count rule* counts rows (or distinct values) per key inside a look-back window
and flags keys above a threshold. Rules are values; ``flag_rows`` and
``count_keys`` turn one into a DataFrame, and ``run_rules`` evaluates a whole
set with one scan for all its pattern rules and one aggregation per distinct
combination of keys for its count rules.

Aggregations combine on the map side, so a hot source moves one partial row per
task. Distinct counts are deduplicated on (key, value) before the key is
shuffled on its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import hour_between, like_any, lower_like_any, since
from duskwatch.operators.geo import with_country

Predicate = Callable[[], Column]


def _always() -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class PatternRule:
    """Flags each row for which ``where`` holds."""

    name: str
    where: Predicate
    columns: tuple[str, ...]
    reason: str
    reason_columns: tuple[str, ...]


@dataclass(frozen=True)
class CountRule:
    """Flags keys with more than ``threshold`` rows in the last ``minutes``."""

    name: str
    where: Predicate
    keys: tuple[str, ...]
    minutes: int
    threshold: int
    metric: str
    reason: str
    reason_columns: tuple[str, ...]
    distinct: str | None = None
    shown: tuple[str, ...] = field(default=())  # non-key columns, reported by their maximum

    def tuned(self, minutes: int | None = None, threshold: int | None = None, **other) -> CountRule:
        """The same rule with another window or threshold."""
        return replace(
            self,
            minutes=self.minutes if minutes is None else minutes,
            threshold=self.threshold if threshold is None else threshold,
            **other,
        )


def _reason(text: str, parts: Sequence[Column]) -> Column:
    return F.format_string(text, *parts) if parts else F.lit(text)


def _count_reason(rule: CountRule, metric: str | Column) -> Column:
    metric = F.col(metric) if isinstance(metric, str) else metric
    named = {"metric": metric, "minutes": F.lit(rule.minutes)}
    return _reason(
        rule.reason,
        [named[c].cast("string") if c in named else F.col(c).cast("string") for c in rule.reason_columns],
    )


# --- single rules -------------------------------------------------------------


def flag_rows(logs: DataFrame, rule: PatternRule) -> DataFrame:
    """Rows matching a pattern rule. Works on batch tables and on streams."""
    return logs.filter(rule.where()).select(
        F.lit(rule.name).alias("anomaly_type"),
        *rule.columns,
        _reason(rule.reason, [F.col(c).cast("string") for c in rule.reason_columns]).alias("reason"),
    )


def _measure(rule: CountRule, counted: Column) -> Column:
    if rule.distinct:
        return F.count_distinct(F.when(counted, F.col(rule.distinct)))
    return F.count_if(counted)


def count_keys(logs: DataFrame, rule: CountRule, as_of) -> DataFrame:
    """Keys over the threshold in ``[as_of - minutes, ...)``; without keys one row or none."""
    hits = logs.filter(rule.where() & since("timestamp", as_of, rule.minutes))
    counted = hits.groupBy(*rule.keys).agg(
        _measure(rule, F.lit(True)).alias(rule.metric),
        *[F.max(c).alias(c) for c in rule.shown],
    )
    return counted.filter(F.col(rule.metric) > rule.threshold).select(
        F.lit(rule.name).alias("anomaly_type"),
        *rule.keys,
        *rule.shown,
        rule.metric,
        _count_reason(rule, rule.metric).alias("reason"),
    )


def count_windows(
    logs: DataFrame,
    rule: CountRule,
    duration: str | None = None,
    slide: str | None = None,
    approximate: bool = False,
) -> DataFrame:
    """A count rule over every tumbling or sliding event-time window.

    On a stream, set a watermark on ``timestamp`` first; windows are then
    emitted in append mode once the watermark has passed them. A stream counts
    distinct values by dropping repeated (window, key, value) rows before it
    counts, so the state of a hot key is spread over its values; ``approximate``
    keeps one sketch per window and key instead.
    """
    duration = duration or f"{rule.minutes} minutes"
    window = F.window("timestamp", duration, slide) if slide else F.window("timestamp", duration)
    rows = logs.filter(rule.where())
    if rule.distinct and approximate:
        measure = F.approx_count_distinct(rule.distinct)
    elif rule.distinct and logs.isStreaming:
        rows = rows.filter(F.col(rule.distinct).isNotNull())
        rows = rows.select(window.alias("window"), *rule.keys, rule.distinct)
        rows = rows.dropDuplicates(["window", *rule.keys, rule.distinct])
        window, measure = F.col("window"), F.count(F.lit(1))
    else:
        measure = _measure(rule, F.lit(True))
    counted = rows.groupBy(window.alias("window"), *rule.keys).agg(measure.alias(rule.metric))
    return counted.filter(F.col(rule.metric) > rule.threshold).select(
        F.lit(rule.name).alias("anomaly_type"),
        *rule.keys,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        rule.metric,
    )


def geo_anomaly(logs: DataFrame, ranges: DataFrame, as_of, hours: int = 1) -> DataFrame:
    """Users whose successful logins in the last hours came from several countries."""
    logins = logs.filter(
        (F.col("event_type") == "login_success") & since("timestamp", as_of, hours * 60)
    ).select("user", "source_ip")
    # one row per (user, ip) before the range join, one per (user, country) before the set
    visits = with_country(logins.distinct(), ranges, "source_ip")
    per_user = (
        visits.select("user", "country")
        .distinct()
        .groupBy("user")
        .agg(F.sort_array(F.collect_list("country")).alias("countries"))
    )
    number = F.size("countries")
    return per_user.filter(number > 1).select(
        F.lit("geo_anomaly").alias("anomaly_type"),
        "user",
        "countries",
        F.format_string(
            fixed.REASON_GEO_ANOMALY, F.col("user"), F.lit(str(hours)), number.cast("string")
        ).alias("reason"),
    )


def blacklist_hits(logs: DataFrame, blacklist: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Distinct sources found in a threat list (one column, same name as ``ip``)."""
    return (
        logs.select(ip)
        .distinct()
        .join(blacklist.select(ip), ip, "left_semi")
        .select(F.lit("blacklist_ip").alias("anomaly_type"), ip, F.lit(fixed.REASON_BLACKLIST).alias("reason"))
    )


# --- rule sets ----------------------------------------------------------------

SHARED = "anomaly_type STRING, source_ip STRING, user STRING, pid BIGINT, metric BIGINT, item STRING, reason STRING"


def _shared_struct(name: str, have: Sequence[str], metric: Column, item: Column, reason: Column) -> Column:
    def given(column: str, kind: str) -> Column:
        return (F.col(column) if column in have else F.lit(None)).cast(kind).alias(column)

    return F.struct(
        F.lit(name).alias("anomaly_type"),
        given("source_ip", "string"),
        given("user", "string"),
        given("pid", "long"),
        metric.cast("long").alias("metric"),
        item.cast("string").alias("item"),
        reason.alias("reason"),
    )


def _item(columns: Sequence[str]) -> Column:
    rest = [F.col(c).cast("string") for c in columns if c not in ("source_ip", "user", "pid")]
    return F.concat_ws(" ", *rest) if rest else F.lit(None)


def _run_patterns(logs: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    wanted = rules[0].where()
    for rule in rules[1:]:
        wanted = wanted | rule.where()
    hits = [
        F.when(
            rule.where(),
            _shared_struct(
                rule.name,
                rule.columns,
                F.lit(None),
                _item(rule.columns),
                _reason(rule.reason, [F.col(c).cast("string") for c in rule.reason_columns]),
            ),
        )
        for rule in rules
    ]
    return logs.filter(wanted).select(F.inline(F.array_compact(F.array(*hits))))


def _run_counts(logs: DataFrame, rules: Sequence[CountRule], as_of) -> DataFrame:
    keys = rules[0].keys
    guards = [rule.where() & since("timestamp", as_of, rule.minutes) for rule in rules]
    wanted = guards[0]
    for guard in guards[1:]:
        wanted = wanted | guard
    measures = [_measure(rule, guard).alias(f"m{i}") for i, (rule, guard) in enumerate(zip(rules, guards))]
    # the widest look-back bounds the scan; each measure applies its own
    recent = logs.filter(since("timestamp", as_of, max(rule.minutes for rule in rules))).filter(wanted)
    counted = recent.groupBy(*keys).agg(
        *measures,
        *[
            F.max(F.when(guard, F.col(c))).alias(f"s{i}_{c}")
            for i, (rule, guard) in enumerate(zip(rules, guards))
            for c in rule.shown
        ],
    )
    hits = []
    for i, rule in enumerate(rules):
        struct = F.struct(
            F.lit(rule.name).alias("anomaly_type"),
            *[
                (
                    F.col(c)
                    if c in keys
                    else F.col(f"s{i}_{c}") if c in rule.shown else F.lit(None)
                )
                .cast(kind)
                .alias(c)
                for c, kind in (("source_ip", "string"), ("user", "string"), ("pid", "long"))
            ],
            F.col(f"m{i}").cast("long").alias("metric"),
            _item(keys).cast("string").alias("item"),
            _count_reason(rule, f"m{i}").alias("reason"),
        )
        hits.append(F.when(F.col(f"m{i}") > rule.threshold, struct))
    return counted.select(F.inline(F.array_compact(F.array(*hits))))


def run_rules(logs: DataFrame, rules: Sequence[PatternRule | CountRule], as_of) -> DataFrame:
    """All rules of a table as one bag of anomalies with a shared schema."""
    parts: list[DataFrame] = []
    patterns = [r for r in rules if isinstance(r, PatternRule)]
    if patterns:
        parts.append(_run_patterns(logs, patterns))
    groups: dict[tuple, list[CountRule]] = {}
    for rule in rules:
        if isinstance(rule, CountRule):
            # a distinct count expands its input, so it does not share a pass with plain counts
            groups.setdefault((rule.keys, rule.distinct), []).append(rule)
    parts += [_run_counts(logs, group, as_of) for group in groups.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def as_shared(found: DataFrame) -> DataFrame:
    """Fit the output of a single rule into the shared anomaly schema."""
    have = found.columns
    metrics = [
        c for c in ("attempts", "users", "total", "connections", "errors", "ports", "packets", "hits")
        if c in have
    ]
    metric = F.col(metrics[0]) if metrics else F.lit(None)
    item = F.concat_ws(",", "countries") if "countries" in have else F.lit(None)
    return found.select(
        F.inline(
            F.array(_shared_struct("", have, metric, item, F.col("reason")).withField("anomaly_type", F.col("anomaly_type")))
        )
    )


def stored_anomalies(found: DataFrame, log_type: str) -> DataFrame:
    """Detector output in the layout of the ``<type>_anomalies`` table.

    ``countries`` becomes a comma list; the write time is added by the sink.
    """
    from duskwatch.schemas import ANOMALY_TABLES

    have = found.columns
    if "countries" in have:
        codes = F.concat_ws(",", "countries")
    elif "item" in have:
        codes = F.when(F.col("anomaly_type") == "geo_anomaly", F.col("item")).otherwise("")
    else:
        codes = F.lit("")
    known = {"details": F.col("reason"), "country_codes": codes}
    return found.select(
        *[
            known.get(c, F.col(c) if c in have else F.lit(None).cast("string")).alias(c)
            for c in ANOMALY_TABLES[log_type]
        ]
    )


def type_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))


def run_total(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("count"))


# --- the rule library ---------------------------------------------------------


def _event(*types: str) -> Predicate:
    return lambda: F.col("event_type").isin(*types)


SSH_BRUTE_FORCE = CountRule(
    "ssh_brute_force", _event("authentication_failure", "invalid_user"), ("source_ip",), 5, 5,
    "attempts", fixed.REASON_SSH_BRUTE_FORCE, ("metric",),
)
SSH_USER_ENUMERATION = CountRule(
    "user_enumeration", _event("invalid_user"), ("source_ip",), 60, 3,
    "users", fixed.REASON_USER_ENUMERATION, ("metric",), distinct="user",
)
SSH_REVERSE_DNS = CountRule(
    "reverse_dns_failure", _event("reverse_dns_failure"), ("source_ip",), 60, 0,
    "total", fixed.REASON_REVERSE_DNS, ("source_ip", "metric"),
)
SSH_HIGH_FREQUENCY = CountRule(
    "high_frequency", _always, ("source_ip",), 1, 50,
    "connections", fixed.REASON_HIGH_FREQUENCY, ("source_ip", "metric", "minutes"),
)
SSH_PORT_SCAN = SSH_HIGH_FREQUENCY.tuned(threshold=100, name="port_scan")
SSH_GLOBAL_DDOS = CountRule(
    "global_ddos_attack", _event("invalid_user"), (), 1, 60,
    "attempts", fixed.REASON_GLOBAL_DDOS, ("metric",),
)
SSH_DISTINCT_PORTS = CountRule(
    "port_scanning", _event("connection_attempt", "invalid_port"), ("source_ip",), 5, 3,
    "ports", fixed.REASON_SSH_PORT_SCANNING, ("metric",), distinct="port",
)
SSH_PROTOCOL = CountRule(
    "protocol_anomaly",
    lambda: F.col("event_type").isin("connection_attempt") & (F.col("port") != 22),
    ("source_ip", "port"), 60, 2,
    "attempts", fixed.REASON_SSH_PROTOCOL, ("port", "metric"),
)
SSH_RULES = [
    SSH_BRUTE_FORCE, SSH_USER_ENUMERATION, SSH_REVERSE_DNS, SSH_HIGH_FREQUENCY, SSH_PORT_SCAN,
]


def run_ssh(logs: DataFrame, ranges: DataFrame, as_of, hours: int = 1, rules=None) -> DataFrame:
    """The SSH set: the count rules plus the geographic rule."""
    counted = run_rules(logs, rules or SSH_RULES, as_of)
    return counted.unionByName(as_shared(geo_anomaly(logs, ranges, as_of, hours)))


WEB_SQL_INJECTION = PatternRule(
    "sql_injection", lambda: like_any("path", fixed.SQL_INJECTION_PATHS),
    ("source_ip", "path"), fixed.REASON_SQL_INJECTION, ("path",),
)
WEB_XSS = PatternRule(
    "xss", lambda: like_any("path", fixed.XSS_PATHS), ("source_ip", "path"), fixed.REASON_XSS, ("path",),
)
WEB_BRUTE_FORCE = CountRule(
    "web_brute_force", lambda: F.col("status_code").isin(401, 403), ("source_ip",), 5, 20,
    "attempts", fixed.REASON_WEB_BRUTE_FORCE, ("metric",),
)
WEB_SCANNER = CountRule(
    "scanner", lambda: F.col("status_code") == 404, ("source_ip",), 10, 50,
    "errors", fixed.REASON_SCANNER, ("metric",),
)
WEB_TRAVERSAL = PatternRule(
    "directory_traversal", lambda: like_any("path", fixed.TRAVERSAL_PATHS),
    ("source_ip", "path"), fixed.REASON_TRAVERSAL, ("path",),
)
WEB_SENSITIVE = PatternRule(
    "sensitive_file_access", lambda: like_any("path", fixed.SENSITIVE_PATHS),
    ("source_ip", "path"), fixed.REASON_SENSITIVE, ("path",),
)
WEB_AGENT = PatternRule(
    "suspicious_user_agent", lambda: lower_like_any("user_agent", fixed.SUSPICIOUS_AGENTS),
    ("source_ip", "user_agent"), fixed.REASON_AGENT, ("user_agent",),
)
WEB_HIGH_FREQUENCY = CountRule(
    "high_frequency_requests", _always, ("source_ip", "path"), 1, 100,
    "hits", fixed.REASON_HIGH_FREQUENCY_REQUESTS, ("path", "metric"),
)
WEB_METHOD = PatternRule(
    "abnormal_http_method", lambda: ~F.col("method").isin(*fixed.USUAL_HTTP_METHODS),
    ("source_ip", "method", "path"), fixed.REASON_HTTP_METHOD, ("method", "path"),
)
WEB_RULES = [
    WEB_SQL_INJECTION, WEB_XSS, WEB_BRUTE_FORCE, WEB_SCANNER, WEB_TRAVERSAL, WEB_SENSITIVE,
    WEB_AGENT, WEB_HIGH_FREQUENCY, WEB_METHOD,
]

FIREWALL_PORT_SCAN = CountRule(
    "port_scan", lambda: F.col("action") == "DROP", ("source_ip",), 5, 20,
    "ports", fixed.REASON_FIREWALL_PORT_SCAN, ("metric",), distinct="dest_port",
)
FIREWALL_DDOS = CountRule(
    "ddos",
    lambda: (F.col("protocol") == "TCP") & (F.col("dest_port") == 80) & (F.col("action") == "DROP"),
    ("source_ip",), 1, 1000, "packets", fixed.REASON_FIREWALL_DDOS, ("metric",),
)
FIREWALL_PROTOCOL = PatternRule(
    "abnormal_protocol",
    lambda: (F.col("protocol") == "UDP") & F.col("dest_port").isin(*fixed.UDP_PORTS_OF_CONCERN),
    ("source_ip", "dest_port", "protocol"), fixed.REASON_PROTOCOL, ("protocol", "dest_port"),
)
FIREWALL_OUTBOUND = PatternRule(
    "internal_outbound",
    lambda: F.col("source_ip").startswith(fixed.INTERNAL_PREFIX)
    & ~F.col("dest_ip").startswith(fixed.INTERNAL_PREFIX)
    & (F.col("action") == "DROP"),
    ("source_ip", "dest_ip"), fixed.REASON_OUTBOUND, ("dest_ip",),
)
FIREWALL_RULES = [FIREWALL_PORT_SCAN, FIREWALL_DDOS, FIREWALL_PROTOCOL, FIREWALL_OUTBOUND]

MYSQL_BRUTE_FORCE = CountRule(
    "brute_force", _event("auth_failure"), ("source_ip",), 60, 5,
    "attempts", fixed.REASON_MYSQL_BRUTE_FORCE, ("metric",),
)
MYSQL_HIGH_RISK = PatternRule(
    "high_risk_sql",
    lambda: (F.col("event_type") == "high_risk_operation")
    & like_any("sql_statement", fixed.DROP_TABLE_STATEMENTS),
    ("user", "source_ip", "sql_statement"), fixed.REASON_HIGH_RISK_SQL, ("sql_statement",),
)
MYSQL_PRIVILEGE = PatternRule(
    "privilege_change", lambda: like_any("sql_statement", fixed.PRIVILEGE_STATEMENTS),
    ("user", "sql_statement"), fixed.REASON_PRIVILEGE, ("sql_statement",),
)
MYSQL_EXPORT = PatternRule(
    "data_exfiltration",
    lambda: F.col("sql_statement").ilike(fixed.EXPORT_STATEMENT)
    & ~F.col("sql_statement").ilike(fixed.LIMITED_STATEMENT),
    ("user", "source_ip", "sql_statement"), fixed.REASON_EXPORT, ("sql_statement",),
)
MYSQL_OFF_HOURS = PatternRule(
    "off_hour_access", lambda: hour_between("timestamp", 0, 5),
    ("user", "source_ip"), fixed.REASON_OFF_HOURS, ("sql_statement",),
)
MYSQL_RULES = [MYSQL_BRUTE_FORCE, MYSQL_HIGH_RISK, MYSQL_PRIVILEGE, MYSQL_EXPORT, MYSQL_OFF_HOURS]

HDFS_SERVICE = CountRule(
    "service_brute_force", lambda: F.col("Eventid") == "E3", ("component",), 5, 3,
    "attempts", fixed.REASON_SERVICE_BRUTE_FORCE, ("component", "metric"), shown=("pid",),
)
HDFS_DELETIONS = CountRule(
    "abnormal_deletions", lambda: F.col("Eventid").isin("E4", "E8"), ("pid",), 5, 5,
    "hits", fixed.REASON_DELETIONS, ("pid", "metric"),
)
HDFS_TRANSMISSION = CountRule(
    "transmission_failures", lambda: F.col("Eventid") == "E10", (), 5, 5,
    "hits", fixed.REASON_TRANSMISSION, ("metric",), shown=("pid",),
)
HDFS_RULES = [HDFS_SERVICE, HDFS_DELETIONS, HDFS_TRANSMISSION]

# Optional presets: 10 failures in 5 minutes.
SSH_BRUTE_FORCE_STRICT = SSH_BRUTE_FORCE.tuned(minutes=5, threshold=10)
