"""Queries, joins and statistics over logs, rules and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.predicates import contains_any, moment, score_band
from duskwatch.functions.timecols import hour_text, micros
from duskwatch.plans.ordering import row_index
from duskwatch.plans.selection import has_bins, rows_between

# --- filters ------------------------------------------------------------------


def filter_logs(
    logs: DataFrame,
    source_ip: str | None = None,
    event_type: str | None = None,
    detected_by: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Conjunction of the given equality filters and the closed time range."""
    wanted = {"source_ip": source_ip, "event_type": event_type, "detected_by": detected_by}
    for name, value in wanted.items():
        if value is not None:
            logs = logs.filter(F.col(name) == value)
    if start is not None:
        logs = logs.filter(F.col("timestamp") >= moment(start))
    if end is not None:
        logs = logs.filter(F.col("timestamp") <= moment(end))
    return logs


def newest_first(rows: DataFrame, ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    order = [F.col(ts).desc_nulls_last()] + ([F.col(tie).desc()] if tie else [])
    return rows.orderBy(*order)


def filter_scored(rows: DataFrame, band: str | None = None, search: str | None = None) -> DataFrame:
    """Scored windows of one band whose text holds ``search``, ignoring case."""
    rows = rows.withColumn("band", score_band("score"))
    if band:
        rows = rows.filter(F.col("band") == band)
    if search:
        rows = rows.filter(F.contains(F.lower("text"), F.lit(search.lower())))
    return rows


def resort(rows: DataFrame, by: str = "score", descending: bool = True, tie: str = "idx") -> DataFrame:
    """Windows by ``score`` or by position, in either direction."""
    column = F.col(by)
    return rows.orderBy(column.desc() if descending else column.asc(), F.col(tie))


# --- joins --------------------------------------------------------------------


def anomalies_of_logs(anomalies: DataFrame, rules: DataFrame, log_id: int | None = None) -> DataFrame:
    """Anomalies with the name of their rule, or null; of one log or of all."""
    if log_id is not None:
        anomalies = anomalies.filter(F.col("log_id") == log_id)
    names = rules.select("rule_id", F.col("name").alias("rule_name"))
    return anomalies.join(names, "rule_id", "left")


def high_risk(anomalies: DataFrame, logs: DataFrame, threshold: float = 0.7, limit: int | None = 100) -> DataFrame:
    """Anomalies scored at or above the threshold, or found by rules, best first."""
    risky = anomalies.filter((F.col("score") >= threshold) | (F.col("detected_by") == "rules"))
    joined = risky.join(logs.select("log_id", "source_ip", "event_type"), "log_id")
    if limit is None:
        return joined
    return joined.orderBy(F.col("score").desc_nulls_last(), "anomaly_id").limit(limit)


def anomaly_listing(anomalies: DataFrame, logs: DataFrame, start=None, end=None) -> DataFrame:
    """Anomalies joined to the logs of a time range."""
    kept = filter_logs(logs, start=start, end=end).select("log_id", "source_ip", "timestamp", "message")
    return anomalies.join(kept, "log_id").select(
        F.col("anomaly_id").alias("id"),
        F.col("source_ip").alias("source"),
        F.col("anomaly_type").alias("event_category"),
        F.lit("anomaly").alias("data_type"),
        F.col("timestamp").alias("event_time"),
        F.col("message").alias("description"),
    )


def anomaly_details(anomalies: DataFrame, logs: DataFrame, rules: DataFrame, related: int = 5) -> DataFrame:
    """Each anomaly with its log, its rule and the newest other anomalies of its type.

    The newest ``related + 1`` anomalies of a type are enough to list the
    ``related`` newest others of any anomaly, so the per-type list stays short
    however common the type is.
    """
    ranked_order = F.struct(F.col("created_at"), F.col("anomaly_id"))
    # a bounded list per type: each task keeps its own newest before the shuffle
    newest = _newest_per_key(anomalies, "anomaly_type", ranked_order, related + 1)
    lists = newest.groupBy("anomaly_type").agg(
        F.sort_array(F.collect_list(ranked_order), asc=False).alias("_recent")
    )
    names = rules.select("rule_id", F.col("name").alias("rule_name"), "action")
    logged = logs.select("log_id", "source_ip", "message")
    out = anomalies.join(logged, "log_id", "left").join(names, "rule_id", "left").join(lists, "anomaly_type", "left")
    others = F.filter("_recent", lambda r: r["anomaly_id"] != F.col("anomaly_id"))
    return out.withColumn(
        "related_ids", F.transform(F.slice(others, 1, related), lambda r: r["anomaly_id"])
    ).drop("_recent")


def _newest_per_key(rows: DataFrame, key: str, order: Column, n: int, salts: int = 64) -> DataFrame:
    """The ``n`` largest rows per key, in two steps so that a hot key is split."""
    salted = rows.withColumn("_order", order).withColumn(
        "_salt", F.pmod(F.xxhash64("_order"), F.lit(salts))
    )
    first = Window.partitionBy(key, "_salt").orderBy(F.col("_order").desc())
    second = Window.partitionBy(key).orderBy(F.col("_order").desc())
    return (
        salted.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(second))
        .filter(F.col("_r") <= n)
        .drop("_r", "_salt", "_order")
    )


def merge_detections(rule_hits: DataFrame, model_hits: DataFrame) -> DataFrame:
    """Logs flagged by rules, by a model or by both: ``log_id, detected_by, score``."""
    by_rule = rule_hits.groupBy("log_id").agg(F.count(F.lit(1)).alias("_rules"))
    by_model = model_hits.groupBy("log_id").agg(F.max("score").alias("score"))
    both = by_rule.join(by_model, "log_id", "full_outer")
    state = (
        F.when(F.col("_rules").isNotNull() & F.col("score").isNotNull(), "both")
        .when(F.col("_rules").isNotNull(), "rules")
        .otherwise("AI")
    )
    return both.select("log_id", state.alias("detected_by"), "score")


def sensitive_logins(logs: DataFrame, users: list[str], whitelist: DataFrame) -> DataFrame:
    """Logins of sensitive users from sources that are not on the whitelist.

    A login without a source is on no whitelist and is reported; a null in the
    whitelist allows nothing and hides nothing.
    """
    return logs.filter(F.col("user").isin(users)).join(whitelist.select("source_ip").distinct(), "source_ip", "left_anti")


def off_hours_logins(logs: DataFrame, employees: DataFrame, first: int = 8, last: int = 18) -> DataFrame:
    """Logins outside working hours by known employees."""
    hour = F.hour("timestamp")
    return logs.filter((hour < first) | (hour > last)).join(employees.select("user").distinct(), "user", "left_semi")


def correlate(left: DataFrame, right: DataFrame, key: str, seconds: int) -> DataFrame:
    """Number of right rows with the same key within ``seconds`` of each left row.

    Pairs are counted through running counts, not produced: a hot key would
    otherwise multiply its own rows. Both sides need ``key`` and ``timestamp``.
    """
    from duskwatch.plans.ordering import scan

    reach = F.lit(seconds * 1_000_000).cast("long")

    def timed(df: DataFrame) -> DataFrame:
        counted = df.groupBy(key, F.col("timestamp").alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))
        return counted.withColumn("_t", micros(counted, "_ts"))

    none = F.lit(0).cast("long")
    ends = timed(left).select(
        key,
        "_ts",
        F.col("_n").alias("_left"),
        F.explode(
            F.array(
                F.struct((F.col("_t") - reach).alias("at"), F.lit(0).alias("kind")),
                F.struct((F.col("_t") + reach).alias("at"), F.lit(2).alias("kind")),
            )
        ).alias("_m"),
    ).select(key, "_ts", "_left", F.col("_m.at").alias("_at"), F.col("_m.kind").alias("_kind"), none.alias("_n"))
    points = timed(right).select(
        key, "_ts", none.alias("_left"), F.col("_t").alias("_at"), F.lit(1).alias("_kind"), "_n"
    )
    counted = scan(ends.unionByName(points), ["_at", "_kind"], [key], sums={"_cum": "_n"})
    signed = F.when(F.col("_kind") == 2, F.col("_cum")).otherwise(-F.col("_cum"))
    return (
        counted.filter("_kind <> 1")
        .groupBy(key, F.col("_ts").alias("timestamp"))
        .agg(F.max("_left").alias("rows"), F.sum(signed).alias("matches"))
    )


def event_steps(logs: DataFrame, key: str = "source_ip") -> DataFrame:
    """How often one event type follows another for the same source."""
    from duskwatch.plans.ordering import scan

    steps = scan(
        logs.select(key, "timestamp", "log_id", "event_type"),
        ["timestamp", "log_id"], [key], lasts={"previous": "event_type"}, exclusive=True,
    )
    return (
        steps.filter("previous IS NOT NULL")
        .groupBy("previous", "event_type")
        .agg(F.count(F.lit(1)).alias("count"))
    )


# --- statistics ---------------------------------------------------------------


def per_hour(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    return rows.groupBy(hour_text(ts).alias("hour")).agg(F.count(F.lit(1)).alias("count")).orderBy("hour")


def per_type(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy(F.col("anomaly_type").alias("type")).agg(F.count(F.lit(1)).alias("count"))


def dashboard(anomalies: DataFrame, logs: DataFrame, as_of, period: str = "month", top: int = 10) -> DataFrame:
    """Counts of the current day, week or month by severity, type and attacked source.

    One pass over the joined anomalies: grouping sets give all three breakdowns.
    """
    start = F.date_trunc(period, moment(as_of)).cast("timestamp_ntz")
    recent = anomalies.filter(F.col("created_at") >= start)
    joined = recent.join(logs.select("log_id", "source_ip"), "log_id", "left").select(
        score_band("score").alias("severity"), "anomaly_type", "source_ip"
    )
    counted = joined.groupingSets(
        [[F.col("severity")], [F.col("anomaly_type")], [F.col("source_ip")]],
        F.col("severity"), F.col("anomaly_type"), F.col("source_ip"),
    ).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("count"))
    labelled = counted.select(
        F.when(F.col("_g") == 3, "severity").when(F.col("_g") == 5, "type").otherwise("source").alias("section"),
        F.coalesce("severity", "anomaly_type", "source_ip").alias("item"),
        "count",
    )
    sources = (
        labelled.filter("section = 'source'").orderBy(F.desc("count"), "item").limit(top)
    )
    return labelled.filter("section <> 'source'").unionByName(sources)


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of an ordered listing, with the total row count on every row.

    Times and numbers are narrowed down to the page by counting; a listing
    ordered by other columns is ranked as a whole.
    """
    first, total = (number - 1) * size, rows.count()
    if has_bins(rows, order):
        found = rows_between(rows, order, first, size)
    else:
        ranked = row_index(rows, order, name="_row")
        found = ranked.filter((F.col("_row") >= first) & (F.col("_row") < first + size)).drop("_row")
    return found.withColumn("total", F.lit(total).cast("long"))


def word_counts(rows: DataFrame, text: str = "message", top: int = 20) -> DataFrame:
    """Most frequent cleaned words."""
    from duskwatch.functions.text import tokens

    return (
        rows.select(F.explode(tokens(text)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "word")
        .limit(top)
    )


def mentions_any(rows: DataFrame, column: str, words: list[str]) -> DataFrame:
    return rows.filter(contains_any(column, words))
