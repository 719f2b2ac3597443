"""From any number of question texts to their rows, in one plan.

Questions become intents with columns (``read_intent``), one row per template a
question selects. Logs are read once and meet the intents by an equi-join on the
days their time range covers, so a log row is only compared with questions about
its day; the exact range and the names in the question are checked after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import like_any, moment
from duskwatch.functions.timecols import back_from
from duskwatch.operators.questions import read_intent

# Rows (question, template, day) that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
ANSWER = (
    "question_id, kind, id, count, entity_name, source, event_category, data_type, event_time, description".split(", ")
)


def intents(questions: DataFrame, as_of, question: str = "question", ident: str = "question_id") -> DataFrame:
    """One row per question and selected template: ``question_id, kind``, range, names and row limit.

    A question that asks for a merged answer selects its best two templates. A
    relative range ends at ``as_of``; a question without times means the last 24
    hours.
    """
    read = read_intent(questions.select(F.col(ident).alias("question_id"), F.col(question).alias("question")), as_of)
    now = moment(as_of)
    relative = F.coalesce(F.col("time_type"), F.lit("relative")) == "relative"
    dated = ~relative & (F.col("time_start").isNotNull() | F.col("time_end").isNotNull())
    amount = F.when(relative & (F.coalesce("time_value", F.lit(0)) != 0), F.col("time_value")).otherwise(24).cast("int")
    unit = F.when(relative, F.coalesce("time_unit", F.lit("hour"))).otherwise("hour")
    back = back_from(as_of, amount, unit)
    kinds = F.slice("kinds", 1, F.when(F.col("merge"), 2).otherwise(1))
    return read.select(
        "question_id",
        F.explode(kinds).alias("kind"),
        F.when(dated, F.col("time_start")).otherwise(back).alias("from"),
        F.when(dated, F.col("time_end")).otherwise(now).alias("to"),
        "event",
        "status",
        "user",
        "ip",
        F.coalesce("row_limit", F.lit(100)).alias("row_limit"),
    )


def _spelled(kind: str, value: Column) -> Column:
    """Every listed way a message may mention ``value``, for values in a column."""
    lists = {"user": fixed.USER_SPELLINGS, "source_ip": fixed.IP_SPELLINGS}
    texts = [F.replace(F.lit(text), F.lit("{v}"), value) for text in lists[kind]]
    if kind == "user":
        texts += [F.concat(F.lit("user="), F.lower(value)), F.concat(F.lit("username="), F.lower(value))]
    return F.array(value, *texts)


def _plain(value: Column) -> Column:
    """Whether LIKE reads the value as it is written."""
    return ~F.rlike(value, F.lit(r"[%_\\]"))


def _prepared(name: str) -> dict[str, Column]:
    return {f"_{name}_plain": _plain(F.col(name)), f"_{name}_low": F.lower(name)}


def _mentions(kind: str, name: str, patterns: str) -> Column:
    """No name in the question, the field equals it, or the message mentions it.

    Every spelling holds the value itself, which is one of the patterns, so a plain
    value is looked for as it is: no pattern is compiled per row.
    """
    value, plain, low = F.col(f"_{name}"), F.col(f"_{name}_plain"), F.col(f"_{name}_low")
    same = F.when(plain, F.lower(kind) == low).otherwise(F.ilike(F.col(kind), value))
    spelled = F.exists(patterns, lambda p: F.ilike(F.col("message"), F.concat(F.lit("%"), p, F.lit("%"))))
    said = F.when(plain, F.contains("_message", low)).otherwise(spelled)
    return value.isNull() | F.coalesce(same, F.lit(False)) | F.coalesce(said, F.lit(False))


def _matched(logs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log rows with the intent they meet, one row per pair."""
    first, last = logs.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        first = last = "1970-01-01 00:00:00"
    start = F.greatest(F.coalesce("from", moment(first)), moment(first))
    end = F.least(F.coalesce("to", moment(last)), moment(last))
    days = F.when(
        start <= end, F.sequence(F.to_date(start), F.to_date(end))
    )
    named = wanted.withColumns(
        {"_users": _spelled("user", F.col("user")), "_ips": _spelled("source_ip", F.col("ip"))}
        | _prepared("user") | _prepared("ip") | _prepared("status")
    )
    renamed = named.withColumn("_day", F.explode(days)).withColumnsRenamed({"user": "_user", "ip": "_ip", "event": "_event", "status": "_status"})
    small = renamed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    at = F.col("timestamp")
    status = F.when(F.col("_status_plain"), F.contains("_message", F.col("_status_low"))).otherwise(
        F.ilike(F.col("message"), F.concat(F.lit("%"), F.col("_status"), F.lit("%")))
    )
    pairs = logs.withColumns({"_day": F.to_date("timestamp"), "_message": F.lower("message")}).join(F.broadcast(renamed) if small else renamed, "_day")
    return pairs.filter(
        (F.col("from").isNull() | (at >= F.col("from")))
        & (F.col("to").isNull() | (at <= F.col("to")))
        & (F.col("_event").isNull() | (F.col("event_type") == F.col("_event")))
        & ((F.col("kind") == "anomalies") | F.col("_status").isNull() | status)
        & _mentions("user", "user", "_users")
        & _mentions("source_ip", "ip", "_ips")
    )


def _shaped(rows: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    types = {"id": "bigint", "count": "bigint", "event_time": "timestamp_ntz"}
    given = {n: F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
    return rows.select(
        "question_id",
        F.lit(kind).alias("kind"),
        *[given.get(n, F.lit(None)).cast(types.get(n, "string")).alias(n) for n in ANSWER[2:]],
    )


def answer_questions(questions: DataFrame, logs: DataFrame, anomalies: DataFrame, rules: DataFrame, as_of, question: str = "question", ident: str = "question_id") -> DataFrame:
    """The rows of every question: ``question_id, kind`` and the columns its templates give, others null.

    Templates: counted login failures per user and source, anomalies of matching
    logs, all rules, and the newest matching logs up to the question's limit. A
    merged question has the rows of both its templates. A question that nothing
    matches has no row.
    """
    wanted = intents(questions, as_of, question, ident)
    about_logs = _matched(logs, wanted.filter("kind <> 'rules'"))

    failed = about_logs.filter((F.col("kind") == "login_failures") & like_any("message", fixed.FAILURE_MESSAGES))
    counted = failed.groupBy("question_id", "user", "source_ip").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("last"))
    parts = [
        _shaped(
            counted, "login_failures", count="n", entity_name="user", source="source_ip",
            event_category=F.lit("login_failure"), data_type=F.lit("count"), event_time="last",
        )
    ]
    found = about_logs.filter(F.col("kind") == "anomalies").select("question_id", "log_id", "source_ip", "timestamp", "message")
    parts.append(
        _shaped(
            found.join(anomalies.select("anomaly_id", "log_id", "anomaly_type"), "log_id"), "anomalies", id="anomaly_id", source="source_ip",
            event_category="anomaly_type", data_type=F.lit("anomaly"), event_time="timestamp", description="message",
        )
    )
    asked = wanted.filter("kind = 'rules'").select("question_id", "kind")
    listed = rules.withColumn("kind", F.lit("rules")).join(asked, "kind")
    parts.append(
        _shaped(
            listed, "rules", id="rule_id", entity_name="name", source=F.lit(""),
            event_category="action", data_type=F.lit("rule"), event_time="created_at",
        )
    )
    # the largest limit asked for bounds what a task keeps of a question
    most = wanted.agg(F.max("row_limit")).first()[0] or 0
    newest = Window.partitionBy("question_id").orderBy(F.desc("timestamp"), "log_id")
    rows = about_logs.filter(F.col("kind") == "logs").withColumn("_place", F.row_number().over(newest))
    rows = rows.filter(F.col("_place") <= most).filter(F.col("_place") <= F.col("row_limit"))
    parts.append(
        _shaped(
            rows, "logs", id="log_id", source="source_ip", event_category="event_type",
            data_type=F.lit("log"), event_time="timestamp", description="message",
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
