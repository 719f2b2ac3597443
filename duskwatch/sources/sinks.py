"""Validated writes and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.functions.predicates import is_ipv4
from duskwatch.plans.ordering import row_index
from duskwatch.schemas import REQUIRED, columns


def _reject_reason(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), text) for ok, text in checks]))


def _split(df: DataFrame, checks: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    judged = df.withColumn("reject_reasons", _reject_reason(checks))
    valid = judged.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return valid, judged.filter(F.size("reject_reasons") > 0)


def validate_logs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new logs into (valid rows, rejected rows with reasons).

    Missing ``detected_by`` becomes ``none``; a missing time becomes the write time.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    have = set(df.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    ready = df.withColumns(
        {
            "detected_by": F.coalesce(given("detected_by", "string"), F.lit("none")),
            "timestamp": F.coalesce(given("timestamp", "timestamp_ntz"), now),
            "created_at": F.coalesce(given("created_at", "timestamp_ntz"), now),
        }
    )
    checks = [(F.col(c).isNotNull(), f"missing {c}") for c in REQUIRED["logs"]]
    checks += [
        (F.col("source_ip").isNull() | is_ipv4("source_ip"), "Invalid IP address format"),
        (F.col("detected_by").isin(fixed.LOG_DETECTED_BY), "Invalid status"),
    ]
    return _split(ready, checks)


def validate_anomalies(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checks = [
        (F.col("log_id").isNotNull(), "missing log_id"),
        (
            F.coalesce(F.col("detected_by").isin(fixed.ANOMALY_DETECTED_BY), F.lit(False)),
            "detected_by must be 'rules', 'AI', or 'both'",
        ),
    ]
    return _split(df, checks)


def validate_rules(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules need a unique name, a query and a known action (default alert)."""
    names = df.groupBy("name").agg(F.count(F.lit(1)).alias("_same"))
    ready = df.withColumn("action", F.coalesce("action", F.lit("alert"))).join(names, "name", "left")
    checks = [(F.col(c).isNotNull(), f"missing {c}") for c in REQUIRED["rules"]]
    checks += [
        (F.col("name").isNull() | (F.col("_same") == 1), "name is not unique"),
        (F.col("action").isin(fixed.RULE_ACTIONS), "unknown action"),
    ]
    valid, rejected = _split(ready, checks)
    return valid.drop("_same"), rejected.drop("_same")


def check_references(anomalies: DataFrame, logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Anomalies whose log or (given) rule does not exist."""
    seen_logs = logs.select("log_id", F.lit(True).alias("_log"))
    seen_rules = rules.select("rule_id", F.lit(True).alias("_rule"))
    joined = anomalies.join(seen_logs, "log_id", "left").join(seen_rules, "rule_id", "left")
    missing_log = F.col("_log").isNull()
    missing_rule = F.col("rule_id").isNotNull() & F.col("_rule").isNull()
    return joined.filter(missing_log | missing_rule).select(
        "anomaly_id",
        F.when(missing_log & missing_rule, "log and rule").when(missing_log, "log").otherwise("rule").alias("missing"),
    )


def update_status(logs: DataFrame, updates: DataFrame) -> DataFrame:
    """Logs with new ``detected_by`` values from ``updates(log_id, detected_by)``.

    Updates by rules and by AI to one log become ``both``. Unknown values raise
    when the result is computed.
    """
    value = F.when(F.col("detected_by").isin(fixed.LOG_DETECTED_BY), F.col("detected_by")).otherwise(
        F.raise_error(F.concat(F.lit("Invalid status: "), F.coalesce("detected_by", F.lit("null")))).cast("string")
    )
    merged = (
        updates.select("log_id", value.alias("_new"))
        .groupBy("log_id")
        .agg(
            F.max(F.col("_new").isin("rules", "both")).alias("_r"),
            F.max(F.col("_new").isin("AI", "both")).alias("_a"),
        )
        .select(
            "log_id",
            F.when(F.col("_r") & F.col("_a"), "both")
            .when(F.col("_r"), "rules")
            .when(F.col("_a"), "AI")
            .otherwise("none")
            .alias("_new"),
        )
    )
    return logs.join(merged, "log_id", "left").withColumn(
        "detected_by", F.coalesce("_new", "detected_by")
    ).drop("_new")


# --- writes -------------------------------------------------------------------


def with_ids(rows: DataFrame, order: list[str], first: int = 1, name: str = "id") -> DataFrame:
    """Number new rows from ``first`` in the given order, before they are written."""
    return row_index(rows, order, name=name).withColumn(name, F.col(name) + F.lit(first).cast("long"))


def append_table(df: DataFrame, path: str, ts: str | None = "timestamp") -> None:
    """Append to a parquet table, partitioned by day so that look-backs prune folders."""
    if ts and ts in df.columns:
        df.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def append_logs(parsed: DataFrame, log_type: str, path: str) -> None:
    """Append parsed rows of one type with the columns of its table."""
    wanted = [c for c in columns(f"{log_type}_logs") if c in parsed.columns]
    append_table(parsed.select(*wanted), path)


def append_anomalies(found: DataFrame, log_type: str, path: str) -> None:
    from duskwatch.operators.rules import stored_anomalies

    rows = stored_anomalies(found, log_type).withColumn(
        "timestamp", F.current_timestamp().cast("timestamp_ntz")
    )
    append_table(rows, path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def key_values(report: DataFrame) -> DataFrame:
    """A one-row report as ``(section, key, value)`` rows; a struct column is a section."""
    entries = []
    for field in report.schema.fields:
        if field.dataType.typeName() == "struct":
            for inner in field.dataType.fields:
                entries.append((field.name, inner.name, F.col(field.name)[inner.name]))
        else:
            entries.append(("report", field.name, F.col(field.name)))

    def text(value: Column) -> Column:
        return F.to_json(F.struct(value.alias("v")))

    rows = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(key).alias("key"),
            F.get_json_object(text(value), "$.v").alias("value"),
        )
        for section, key, value in entries
    ]
    return report.select(F.inline(F.array(*rows)))


def prediction_rows(scored: DataFrame, threshold: float) -> DataFrame:
    """Per-sample prediction records for the JSON-lines export."""
    predicted = (F.col("score") > threshold).cast("int")
    methods = [c for c in fixed.METHODS if c in scored.columns]
    details = F.struct(*[F.col(m) for m in methods]) if methods else F.struct(F.lit(None).cast("double").alias("none"))
    optional = [
        (F.col(c) if c in scored.columns else F.lit(None).cast("double")).alias(c)
        for c in ("contrastive_distance", "reconstruction_error")
    ]
    return scored.select(
        "id",
        "text",
        F.col("label").alias("true_label"),
        "score",
        *optional,
        predicted.alias("predicted_label"),
        (predicted == F.col("label")).alias("correct"),
        details.alias("method_scores"),
        F.to_json(details).alias("method_details"),
    )
