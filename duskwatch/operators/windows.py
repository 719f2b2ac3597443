"""Windows over log lines.

Input is ``(seq_id, idx, line)`` with a dense zero-based ``idx`` per sequence;
``with_index`` makes it from any ordered columns. Count windows collect at most
``size`` lines per group, however long a sequence is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed
from duskwatch.plans.ordering import blocks, row_index, scan


def with_index(rows: DataFrame, order: Sequence[str], seq: str = "seq_id") -> DataFrame:
    return row_index(rows, order, [seq])


def _gather(placed: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("idx", "line")))
    return (
        placed.groupBy("seq_id", "window_idx")
        .agg(F.min("idx").alias("start_idx"), (F.max("idx") + 1).alias("end_idx"), ordered.alias("_lines"))
        .withColumn("logs", F.transform("_lines", lambda x: x["line"]))
        .withColumn("text", F.array_join("logs", fixed.WINDOW_SEPARATOR))
        .drop("_lines")
    )


def fixed_windows(lines: DataFrame, size: int, spread: bool = False) -> DataFrame:
    """Consecutive windows of ``size`` lines; a shorter last window is kept."""
    placed = lines.withColumn("window_idx", F.floor(F.col("idx") / size))
    return _gather(_spread(placed, "window_idx") if spread else placed)


def _spread(rows: DataFrame, place: str) -> DataFrame:
    """Deal groups out to a fixed number of tasks, for work that costs more than its bytes tell.

    The grouping that follows needs no shuffle of its own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "seq_id", place)


def sliding_windows(lines: DataFrame, size: int, stride: int = 1, keep_single: bool = False, spread: bool = False, block: int = 10_000) -> DataFrame:
    """Full windows of ``size`` lines every ``stride`` lines.

    A sequence shorter than ``size`` has none; with ``keep_single`` a sequence
    of one line still gives one window of one line. Lines meet in blocks of the
    index that carry the first ``size - 1`` lines of the next block, so a line is
    shuffled once or twice, not once per window.
    """
    block = max(block, size)
    placed = blocks(lines.select("seq_id", "idx", "line"), "idx", size - 1, block, ahead=True)
    placed = _spread(placed, "_block") if spread else placed
    held = placed.groupBy("seq_id", "_block").agg(F.array_sort(F.collect_list(F.struct("idx", "line"))).alias("_lines"))
    # the block of a halo may hold no line of its own
    held = held.withColumn("_low", F.col("_lines")[0]["idx"]).filter(F.floor(F.col("_low") / block) == F.col("_block"))
    first = F.ceil(F.col("_low") / stride)
    last_own = F.least((F.col("_block") + 1) * block - 1, F.col("_low") + F.size("_lines") - size)
    last = F.floor(last_own / stride)
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    if keep_single:
        starts = F.when((F.col("_low") == 0) & (F.size("_lines") == 1) & (F.lit(size) > 1), F.array(F.lit(0).cast("bigint"))).otherwise(starts)
    cut = held.withColumn("window_idx", F.explode(starts))
    start = F.col("window_idx") * stride
    own = F.slice("_lines", (start - F.col("_low") + 1).cast("int"), F.lit(size))
    return (
        cut.select("seq_id", "window_idx", start.alias("start_idx"), F.transform(own, lambda x: x["line"]).alias("logs"))
        .withColumn("end_idx", F.col("start_idx") + F.size("logs"))
        .withColumn("text", F.array_join("logs", fixed.WINDOW_SEPARATOR))
        .select("seq_id", "window_idx", "start_idx", "end_idx", "logs", "text")
    )


def make_windows(lines: DataFrame, kind: str = "fixed", size: int = 10, stride: int = 1, spread: bool = False) -> DataFrame:
    if kind == "fixed":
        return fixed_windows(lines, size, spread)
    if kind == "sliding":
        return sliding_windows(lines, size, stride, keep_single=True, spread=spread)
    raise ValueError("window type must be fixed or sliding")


def time_windows(rows: DataFrame, ts: str = "timestamp", duration: str = "60 seconds", slide: str = "10 seconds", keys: Sequence[str] = ()) -> DataFrame:
    """Row counts and time span per event-time window that holds rows."""
    window = F.window(ts, duration, slide)
    return rows.groupBy(window.alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("lines"), F.min(ts).alias("first"), F.max(ts).alias("last")
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, "lines", "first", "last")


def bounded_windows(lines: DataFrame, start: Column, end: Column) -> DataFrame:
    """For each line matching ``end``: the window from the latest line matching ``start``.

    Returns ``seq_id, start_idx, end_idx, lines``; an end without a start gives none.
    """
    marked = lines.withColumns({"_start": F.when(start, F.col("idx")), "_end": end})
    opened = scan(marked, ["idx"], ["seq_id"], lasts={"start_idx": "_start"})
    return opened.filter(F.col("_end") & F.col("start_idx").isNotNull()).select(
        "seq_id", "start_idx", F.col("idx").alias("end_idx"), (F.col("idx") - F.col("start_idx") + 1).alias("lines")
    )


def moving_average(series: DataFrame, size: int = 20, value: str = "score", block: int = 100_000) -> DataFrame:
    """Mean of the last ``size`` values at each index that has that many; needs more than ``size`` values."""
    if series.limit(size + 1).count() <= size:
        return series.withColumn("moving_avg", F.lit(None).cast("double")).filter(F.lit(False))
    frame = Window.partitionBy("_block").orderBy("idx").rowsBetween(-(size - 1), 0)
    return (
        blocks(series, "idx", size - 1, block)
        .withColumn("moving_avg", F.avg(value).over(frame))
        .filter(F.col("_own") & (F.col("idx") >= size - 1))
        .drop("_block", "_own")
    )


def adaptive_threshold(series: DataFrame, size: int = 100, needed: int = 50, cap: float = 0.95, base: float = 0.7, block: int = 100_000) -> DataFrame:
    """Mean plus two sample deviations of the last ``size`` scores, at most ``cap``.

    Until ``needed`` scores are known ``base`` holds. ``confidence`` is the whole
    percentage of the way from the threshold to 1 (above it) or to 0 (below it).
    """
    frame = Window.partitionBy("_block").orderBy("idx").rowsBetween(-(size - 1), 0)
    spread = F.avg("score").over(frame) + 2 * F.stddev_samp("score").over(frame)
    known = F.count("score").over(frame)
    out = (
        blocks(series, "idx", size - 1, block)
        .withColumn("threshold", F.when(known >= needed, F.least(spread, F.lit(cap))).otherwise(F.lit(base)))
        .filter("_own")
        .drop("_block", "_own")
    )
    above = F.col("score") > F.col("threshold")
    side = F.when(above, 1 - F.col("threshold")).otherwise(F.col("threshold"))
    share = F.abs(F.col("score") - F.col("threshold")) / F.nullif(side, F.lit(0.0))
    return out.withColumn("confidence", F.least(F.floor(share * 100), F.lit(100)).cast("int"))


def window_members(windows: DataFrame) -> DataFrame:
    """One row per window and member line, from the window's own line list."""
    return windows.select(
        "seq_id", "window_idx", F.posexplode("logs").alias("_at", "line"), "start_idx"
    ).select("seq_id", "window_idx", (F.col("start_idx") + F.col("_at")).alias("idx"), "line")
