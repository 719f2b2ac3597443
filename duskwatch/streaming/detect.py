"""The look-back rules, statistics and banks over unbounded logs.

Streams carry ``timestamp`` as TIMESTAMP; ``event_time`` casts it and sets the
watermark. Windowed rules emit in append mode once the watermark has passed a
window, so their results are final. State stays bounded: open windows per key,
one row per method, or a bank of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from duskwatch.functions.predicates import moment
from duskwatch.functions.timecols import as_instant
from duskwatch.operators import rules as R
from duskwatch.operators.geo import with_country
from duskwatch.operators.scores import merge_stats, score_stats
from duskwatch.session import new_folder
from duskwatch.streaming.state import advance, before_batch, newest, run


def event_time(logs: DataFrame, delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Cast the event time for streaming and accept rows up to ``delay`` late."""
    return logs.withColumn(ts, as_instant(logs, ts)).withWatermark(ts, delay)


def windowed_rule(logs: DataFrame, rule: R.CountRule, delay: str = "10 minutes", duration: str | None = None, slide: str | None = None, approximate: bool = False) -> DataFrame:
    """A count, distinct or global rule per event-time window."""
    return R.count_windows(event_time(logs, delay), rule, duration, slide, approximate)


def pattern_rule(logs: DataFrame, rule: R.PatternRule) -> DataFrame:
    return R.flag_rows(logs, rule)


def geo_rule(logs: DataFrame, ranges: DataFrame, delay: str = "10 minutes", duration: str = "1 hour") -> DataFrame:
    """Users with logins from several countries within a window."""
    logins = event_time(logs, delay).filter(F.col("event_type") == "login_success")
    located = with_country(logins, ranges, "source_ip")
    # the set holds country codes, a few hundred values at most
    return (
        located.groupBy(F.window("timestamp", duration).alias("window"), "user")
        .agg(F.sort_array(F.collect_set("country")).alias("countries"))
        .filter(F.size("countries") > 1)
        .select("user", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "countries")
    )


def without_duplicates(logs: DataFrame, columns: Sequence[str] = ("timestamp", "source_ip", "message"), delay: str = "1 hour") -> DataFrame:
    """Drop repeated uploads of the same line within the watermark."""
    return event_time(logs, delay).dropDuplicatesWithinWatermark(list(columns))


def merged_alerts(alerts: DataFrame, keys: Sequence[str] = ("source_ip", "anomaly_type"), gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Alerts of one source and type merged while they follow within ``gap``."""
    session = F.session_window("timestamp", gap)
    return (
        event_time(alerts, delay)
        .groupBy(session.alias("session"), *keys)
        .agg(F.count(F.lit(1)).alias("alerts"))
        .select(*keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "alerts")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str | None = None, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Write a stream to parquet; with ``once`` process what is there and stop."""
    checkpoint = checkpoint or new_folder(stream.sparkSession, "stream-state")
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if not once:
        return writer.start(path)
    started = writer.trigger(availableNow=True).start(path)
    started.awaitTermination()
    return started


def split_late(
    stream: DataFrame, folder: str, delay: str = "10 minutes", ts: str = "timestamp", closes: Column | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Part a stream into ``folder/on-time`` and ``folder/late``, batch by batch.

    A row is late if the watermark, the newest time of all earlier batches minus
    ``delay``, has passed ``closes`` (by default its own time; the end of its
    window where windows are counted). The newest time is carried from batch to
    batch with the rows' own progress, so every late row is written down however
    long the stream runs. A rule over the on-time rows drops none of them: its
    own watermark is never ahead of this one.

    Both sides are written per batch, so a repeated batch replaces its rows.
    Rows without a time are on time.
    """
    closes = F.col(ts) if closes is None else closes

    def step(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        seen = batch.agg(F.max(ts).alias("newest"))
        return (seen if state is None else state.select("newest").unionByName(seen)).agg(F.max("newest").alias("newest"))

    carry = advance(f"{folder}/watermark", step)

    def each(batch: DataFrame, number: int) -> None:
        known = before_batch(batch.sparkSession, f"{folder}/watermark", number)
        mark = known.first()["newest"] if known is not None else None
        late = F.coalesce(closes <= moment(mark) - F.expr(f"INTERVAL {delay}"), F.lit(False)) if mark is not None else F.lit(False)
        batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.filter(~late).write.mode("overwrite").parquet(f"{folder}/on-time/batch={number}")
        carry(batch, number)

    return run(stream, each, checkpoint)


def side(spark: SparkSession, folder: str, which: str, schema) -> DataFrame:
    """The ``late`` or ``on-time`` rows of a split stream, with the batch they came in."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/{which}")


def running_stats(scores: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Keep ``min, max, sum, count`` per method of a stream of ``(method, score)``."""

    def step(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        fresh = score_stats(batch)
        return fresh if state is None else merge_stats(state, fresh)

    return run(scores, advance(folder, step), checkpoint)


def recent_bank(vectors: DataFrame, folder: str, limit: int, checkpoint: str | None = None) -> StreamingQuery:
    """Keep the newest ``limit`` vectors of a stream of ``(bank_id, ts, vec)``.

    The time and id from which on vectors stay are found by counting, so vectors
    are filtered where they lie and never meet in one task.
    """

    def step(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if state is None else state.unionByName(batch)
        return newest(both, ["ts", "bank_id"], limit)

    return run(vectors.select("bank_id", "ts", "vec"), advance(folder, step), checkpoint)
