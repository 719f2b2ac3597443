"""Questions about logs: typed intent from text, and the query templates it selects.

``read_intent`` turns a column of questions into typed columns with built-in
expressions only, so it runs over any number of questions. ``answer`` builds the
DataFrame for one intent.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import contains_any, like_any, moment
from duskwatch.functions.text import extract
from duskwatch.functions.timecols import back_from, calendar_range, parse_date

_IP = r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
_RELATIVE = r"(最近|过去)(\d+)(小时|天|周|月)"
_SPECIAL = r"(今天|昨天|本周|上周|本月|上个月)"
_AGO = r"(\d+)(小时|天)前"
_BETWEEN = r"从(.+?)到(.+?)(的|之间|$)"
_SEEN = "在指定时间范围内"


def _lookup(words: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), key)


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return contains_any(text, words)


def read_intent(questions: DataFrame, as_of, column: str = "question", year: int = 1900) -> DataFrame:
    """Add ``time_type, time_unit, time_value, time_start, time_end, user, ip, events, event,
    status, anomaly, row_limit, kinds, kind, merge`` to a table of questions.

    Time phrases are read in a fixed order and each is taken out before the
    next one is looked for; the last one found decides the type.
    """
    rows = questions.withColumn("_t0", F.col(column))
    for step, pattern in enumerate((_RELATIVE, _SPECIAL, _AGO, _BETWEEN)):
        rows = rows.withColumns(
            {
                f"_m{step}": F.col(f"_t{step}").rlike(pattern),
                f"_t{step + 1}": F.regexp_replace(f"_t{step}", pattern, _SEEN),
            }
        )
    number, unit = extract("_t0", _RELATIVE, 2).try_cast("int"), extract("_t0", _RELATIVE, 3)
    ago_number, ago_unit = extract("_t2", _AGO, 1).try_cast("int"), extract("_t2", _AGO, 2)
    calendar = calendar_range(F.regexp_extract("_t1", _SPECIAL, 1), as_of)
    from_text, to_text = extract("_t3", _BETWEEN, 1), extract("_t3", _BETWEEN, 2)
    rows = rows.withColumns(
        {
            "time_type": F.when(F.col("_m3"), "absolute")
            .when(F.col("_m2"), "relative")
            .when(F.col("_m1"), "special")
            .otherwise("relative"),
            "time_unit": F.coalesce(_lookup(fixed.TIME_UNITS, F.coalesce(ago_unit, unit)), F.lit("hour")),
            "time_value": F.coalesce(ago_number, number, F.lit(24)),
            "_cal": calendar,
            "_from": parse_date(from_text, year),
            "_to": parse_date(to_text, year),
        }
    ).withColumns(
        {
            "time_start": F.coalesce("_from", "_cal.start"),
            "time_end": F.coalesce("_to", "_cal.end"),
        }
    )
    text, original = F.col("_t4"), F.col(column)
    named = [
        extract(text, r"用户[是为:：\s]*([A-Za-z0-9_.\-]+)"),
        extract(text, r"用户[是为:：\s]*([^\s,，;；的]+)"),
        extract(text, r"([A-Za-z0-9_.\-]+)用户"),
        extract(text, r"([^\s,，;；]+)用户"),
        F.when(F.contains(text, F.lit("admin")), "admin"),
    ]
    found_events = F.array_compact(
        F.array(
            *[
                F.when(
                    F.contains(text, F.lit(word)),
                    F.struct(F.locate(word, text).alias("at"), F.lit(event).alias("event")),
                )
                for word, event in fixed.EVENT_WORDS.items()
            ]
        )
    )
    rows = rows.withColumns(
        {
            "user": F.coalesce(*named),
            "ip": F.coalesce(
                extract(text, r"IP[是为:：\s]*" + _IP), extract(text, r"来自[IP是为:：\s]*" + _IP)
            ),
            "events": F.array_distinct(F.transform(F.array_sort(found_events), lambda e: e["event"])),
            "status": _lookup(fixed.STATUS_WORDS, extract(text, f"({'|'.join(fixed.STATUS_WORDS)})")),
            "anomaly": _any_word(text, fixed.ANOMALY_WORDS),
            "row_limit": F.coalesce(extract(text, r"前(\d+)").try_cast("int"), F.lit(100)),
        }
    )
    failed = _any_word(original, fixed.LOGIN_FAILURE_PHRASES)
    login_and_failure = F.array_contains("events", "login") & (F.col("status") == "failure")
    candidates = [
        ("login_failures", F.when(failed, 8).when(login_and_failure, 5)),
        ("anomalies", F.when(_any_word(original, fixed.ANOMALY_TEMPLATE_WORDS), 7).when(F.col("anomaly"), 4)),
        ("rules", F.when(F.contains(original, F.lit(fixed.RULE_WORD)), 6)),
        ("logs", F.when(_any_word(original, fixed.LOG_WORDS), 5).otherwise(2)),
    ]
    ranked = F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(score.isNotNull(), F.struct((-score).alias("rank"), F.lit(place).alias("place"), F.lit(name).alias("name")))
                    for place, (name, score) in enumerate(candidates)
                ]
            )
        )
    )
    wants_merge = _any_word(F.lower(original), fixed.MERGE_WORDS)
    rows = rows.withColumns({"event": F.get("events", F.lit(0)), "kinds": F.transform(ranked, lambda r: r["name"])})
    rows = rows.withColumns({"kind": F.get("kinds", F.lit(0)), "merge": wants_merge & (F.size("kinds") > 1)})
    return rows.drop(*[f"_t{i}" for i in range(5)], *[f"_m{i}" for i in range(4)], "_cal", "_from", "_to")


def recognise_entities(questions: DataFrame, column: str = "question") -> DataFrame:
    """Add ``users, ips, event_groups, status_groups`` named in a question."""
    lowered = F.lower(column)

    def named(groups: dict[str, Sequence[str]]) -> Column:
        return F.array_compact(F.array(*[F.when(contains_any(lowered, words), name) for name, words in groups.items()]))

    return questions.withColumns(
        {
            "users": named({u: [u] for u in fixed.COMMON_USERS}),
            "ips": F.regexp_extract_all(F.col(column), F.lit(_IP), F.lit(1)),
            "event_groups": named(fixed.EVENT_GROUPS),
            "status_groups": named(fixed.STATUS_GROUPS),
        }
    )


# --- fuzzy predicates ----------------------------------------------------------


def _minimal(patterns: Sequence[str]) -> list[str]:
    """Drop patterns that hold another one: a message matching them matches it too."""
    kept: list[str] = []
    for pattern in sorted(dict.fromkeys(patterns), key=len):
        if not any(short.lower() in pattern.lower() for short in kept):
            kept.append(pattern)
    return kept


def spellings(kind: str, value: str) -> list[str]:
    """Every listed way a message may mention a user, ip or event."""
    lists = {"user": fixed.USER_SPELLINGS, "source_ip": fixed.IP_SPELLINGS, "event_type": fixed.EVENT_SPELLINGS}
    out = [value] + [text.format(v=value) for text in lists[kind]]
    if kind == "user":
        out += [f"user={value.lower()}", f"username={value.lower()}"]
    if kind == "event_type" and value.lower() == "login":
        out += fixed.LOGIN_SYNONYMS
    if kind == "event_type" and value.lower() in ("failure", "failed"):
        out += fixed.FAILURE_SYNONYMS
    return out


def mentions(kind: str, value: str, message: str = "message") -> Column:
    """The field equals the value, or the message mentions it in any spelling."""
    texts = [f"%{p}%" for p in _minimal(spellings(kind, value))]
    return F.coalesce(F.col(kind).ilike(value), F.lit(False)) | like_any(message, texts)


def failed_login(message: str = "message") -> Column:
    return like_any(message, [f"%{p}%" for p in fixed.FAILED_LOGIN_MESSAGES])


def term_variants(term: str) -> list[str]:
    """Variants under which a message term is searched."""
    lowered = term.lower()
    out = [term, term.replace(" ", ""), term.replace(" ", "_"), term.replace("=", ":"), lowered]
    if lowered in fixed.USER_TERMS:
        out += spellings("user", term)
    elif lowered in fixed.FAILURE_TERMS:
        for noun in ("login", "authentication", "access"):
            out += [f"{noun} {lowered}", f"{lowered} {noun}"]
    return out


def message_has(term: str, message: str = "message") -> Column:
    found = like_any(message, [f"%{p}%" for p in _minimal(term_variants(term))])
    if term.lower() in fixed.USER_TERMS:
        found = found | F.coalesce(F.col("user").ilike(term), F.lit(False))
    return found


# --- templates -----------------------------------------------------------------


def time_filter(rows: DataFrame, intent: dict[str, Any], as_of, ts: str = "timestamp") -> DataFrame:
    """Look-back that ends at ``as_of`` for relative ranges, closed range otherwise, 24 hours when nothing is given."""
    column = F.col(ts)
    if intent.get("time_type", "relative") != "relative":
        start, end = intent.get("time_start"), intent.get("time_end")
        if start is not None or end is not None:
            if start is not None:
                rows = rows.filter(column >= moment(start))
            if end is not None:
                rows = rows.filter(column <= moment(end))
            return rows
        start = back_from(as_of, 24, "hour")
    else:
        start = back_from(as_of, int(intent.get("time_value") or 24), intent.get("time_unit") or "hour")
    return rows.filter((column >= start) & (column <= moment(as_of)))


def _matching(logs: DataFrame, intent: dict[str, Any], as_of, status: bool = True) -> DataFrame:
    rows = time_filter(logs, intent, as_of)
    tests: list[Column] = []
    if intent.get("event"):
        tests.append(F.col("event_type") == intent["event"])
    if status and intent.get("status"):
        tests.append(F.col("message").ilike(f"%{intent['status']}%"))
    if intent.get("user"):
        tests.append(mentions("user", intent["user"]))
    if intent.get("ip"):
        tests.append(mentions("source_ip", intent["ip"]))
    return rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows


def login_failures(logs: DataFrame, intent: dict[str, Any], as_of) -> DataFrame:
    failed = _matching(logs, intent, as_of).filter(like_any("message", fixed.FAILURE_MESSAGES))
    counted = failed.groupBy("user", "source_ip").agg(
        F.count(F.lit(1)).alias("count"), F.max("timestamp").alias("event_time")
    )
    return counted.select(
        "count",
        F.col("user").alias("entity_name"),
        F.col("source_ip").alias("source"),
        F.lit("login_failure").alias("event_category"),
        F.lit("count").alias("data_type"),
        "event_time",
    ).orderBy(F.desc("count"), "entity_name", "source")


def anomaly_rows(logs: DataFrame, anomalies: DataFrame, intent: dict[str, Any], as_of) -> DataFrame:
    from duskwatch.operators.records import anomaly_listing

    kept = _matching(logs, intent, as_of, status=False)
    return anomaly_listing(anomalies, kept).orderBy(F.desc("event_time"), "id")


def rule_rows(rules: DataFrame) -> DataFrame:
    return rules.select(
        F.col("rule_id").alias("id"),
        F.col("name").alias("entity_name"),
        F.lit("").alias("source"),
        F.lit("rule").alias("data_type"),
        F.col("action").alias("event_category"),
        F.col("created_at").alias("event_time"),
    ).orderBy(F.desc("event_time"), "id")


def log_rows(logs: DataFrame, intent: dict[str, Any], as_of) -> DataFrame:
    kept = _matching(logs, intent, as_of)
    return (
        kept.orderBy(F.desc("timestamp"), "log_id")
        .limit(int(intent.get("row_limit") or 100))
        .select(
            F.col("log_id").alias("id"),
            F.col("source_ip").alias("source"),
            F.col("event_type").alias("event_category"),
            F.lit("log").alias("data_type"),
            F.col("timestamp").alias("event_time"),
            F.col("message").alias("description"),
        )
    )


def merge_results(first: DataFrame, second: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Six-column results put together by position, as text, without duplicates unless asked."""
    left = first.select(*[F.col(c).cast("string").alias(c) for c in first.columns])
    right = second.select(*[F.col(c).cast("string").alias(n) for c, n in zip(second.columns, first.columns, strict=True)])
    both = left.union(right)
    return both if keep_duplicates else both.distinct()


def answer(intent: dict[str, Any], logs: DataFrame, anomalies: DataFrame, rules: DataFrame, as_of, keep_duplicates: bool = False) -> DataFrame:
    """The result of the best template for an intent, or of the best two when merging."""
    build = {
        "login_failures": lambda: login_failures(logs, intent, as_of),
        "anomalies": lambda: anomaly_rows(logs, anomalies, intent, as_of),
        "rules": lambda: rule_rows(rules),
        "logs": lambda: log_rows(logs, intent, as_of),
    }
    kinds = list(intent.get("kinds") or [intent.get("kind") or "logs"])
    if intent.get("merge") and len(kinds) > 1:
        return merge_results(build[kinds[0]](), build[kinds[1]](), keep_duplicates)
    return build[kinds[0]]()
