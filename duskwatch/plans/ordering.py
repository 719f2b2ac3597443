"""Ordered scans that never put one group, or the whole table, into one task.

A plain window over a hot source, or over the whole table, sorts an unbounded
group in a single task. Here rows are range-partitioned on (keys, order), so a
hot key spans many partitions. Each partition is scanned on its own and receives
the carry of the partitions before it. The carry table has one row per range
partition and key, which bounds every window group used below.

The range-partitioned rows are checkpointed once. Partition bounds come from a
sample, so the same bounds must serve both the partition totals and the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.timecols import micros
from duskwatch.session import shared_dir


def freeze(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, cols: Sequence[str], parts: int | None) -> DataFrame:
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = (
        df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in cols])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in cols])
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_pos", 33))
    )
    return freeze(laid_out)


def _same_slice(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = left["_part"] == right["_part"]
    for key in keys:
        cond = cond & left[key].eqNullSafe(right[key])
    return cond


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the carry on (partition, keys); without keys it has one row per partition."""
    if not keys:
        carry = F.broadcast(carry)  # bounded by the number of range partitions
    cond = _same_slice(rows, carry, keys)
    joined = rows.join(carry, cond, "inner").drop(carry["_part"])
    for key in keys:
        joined = joined.drop(carry[key])
    return joined


def row_index(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "idx",
    parts: int | None = None,
) -> DataFrame:
    """Add the zero-based position of each row within ``keys``, ordered by ``order``.

    ``order`` must be unique within ``keys`` for the result to be repeatable.
    """
    rows = _ranged(df, [*keys, *order], parts)
    sizes = rows.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = _attach(rows, carry, keys)
    return joined.withColumn(name, F.col("_before") + F.col("_pos") - F.col("_first")).drop(
        "_before", "_pos", "_first", "_part"
    )


def scan(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    sums: dict[str, str] | None = None,
    lasts: dict[str, str] | None = None,
    exclusive: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Running sums and running last non-null values within ``keys``.

    ``sums`` and ``lasts`` map a new column to the column it accumulates.
    ``exclusive`` leaves the current row out.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = _ranged(df, [*keys, *order], parts)
    stop = -1 if exclusive else 0
    local = (
        Window.partitionBy("_part", *keys)
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, stop)
    )
    scanned = rows.select(
        "*",
        *[F.sum(src).over(local).alias(f"_l_{dst}") for dst, src in sums.items()],
        *[F.last(src, ignorenulls=True).over(local).alias(f"_l_{dst}") for dst, src in lasts.items()],
    )
    totals = rows.groupBy("_part", *keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(src).alias(f"_t_{dst}") for dst, src in sums.items()],
        *[
            F.max_by(src, F.when(F.col(src).isNotNull(), F.col("_pos"))).alias(f"_t_{dst}")
            for dst, src in lasts.items()
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "_part",
        *keys,
        *[F.sum(f"_t_{dst}").over(before).alias(f"_c_{dst}") for dst in sums],
        *[F.last(f"_t_{dst}", ignorenulls=True).over(before).alias(f"_c_{dst}") for dst in lasts],
    )
    joined = _attach(scanned, carry, keys)
    keep = [joined[c] for c in df.columns]
    return joined.select(
        *keep,
        *[
            (F.coalesce(f"_l_{d}", F.lit(0)) + F.coalesce(f"_c_{d}", F.lit(0))).alias(d)
            for d in sums
        ],
        *[F.coalesce(f"_l_{d}", f"_c_{d}").alias(d) for d in lasts],
    )


def blocks(df: DataFrame, idx: str, reach: int, size: int = 100_000, ahead: bool = False) -> DataFrame:
    """Cut a dense index into blocks, copying ``reach`` edge rows to the neighbour block.

    Adds ``_block`` and ``_own``; only ``_own`` rows belong to the block. A frame
    of up to ``reach`` rows back (or forward when ``ahead``) then stays inside a
    group of at most ``size + reach`` rows.
    """
    if reach > size:
        raise ValueError("a frame must not be longer than a block")
    block = F.floor(F.col(idx) / size).cast("long")
    offset = F.col(idx) % size
    edge, neighbour = (offset < reach, block - 1) if ahead else (offset >= size - reach, block + 1)
    home = F.struct(block.alias("b"), F.lit(True).alias("own"))
    copy = F.struct(neighbour.alias("b"), F.lit(False).alias("own"))
    places = F.when(edge, F.array(home, copy)).otherwise(F.array(home))
    return df.withColumn("_place", F.explode(places)).select(
        *df.columns, F.col("_place.b").alias("_block"), F.col("_place.own").alias("_own")
    )


def lookback_counts(df: DataFrame, keys: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """For each (keys, ts): rows of the key in the closed range [ts - seconds, ts].

    The count is a difference of two running counts, so a hot key needs no
    group of its own: markers placed at ``ts - seconds`` are scanned together
    with the rows.
    """
    per_time = df.groupBy(*keys, F.col(ts).alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))
    per_time = per_time.withColumn("_t", micros(per_time, "_ts"))
    both = per_time.select(
        *keys,
        "_ts",
        F.explode(
            F.array(
                F.struct(
                    (F.col("_t") - F.lit(seconds * 1_000_000).cast("long")).alias("at"),
                    F.lit(0).alias("kind"),
                    F.lit(0).cast("long").alias("n"),
                ),
                F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind"), F.col("_n").alias("n")),
            )
        ).alias("_m"),
    ).select(*keys, "_ts", F.col("_m.at").alias("_at"), F.col("_m.kind").alias("_kind"), F.col("_m.n").alias("_n"))
    counted = scan(both, ["_at", "_kind"], keys, sums={"_cum": "_n"})
    signed = F.when(F.col("_kind") == 1, F.col("_cum")).otherwise(-F.col("_cum"))
    return counted.groupBy(*keys, F.col("_ts").alias(ts)).agg(F.sum(signed).alias("hits"))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int) -> DataFrame:
    """Group rows of a key whose distance to the previous row is below ``gap_seconds``.

    Rows of equal time are counted together first, so the scans run over
    distinct times. Returns keys, ``session_start``, ``session_last``, ``hits``.
    """
    per_time = df.groupBy(*keys, F.col(ts).alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))
    per_time = per_time.withColumn("_t", micros(per_time, "_ts"))
    previous = scan(per_time, ["_t"], keys, lasts={"_prev": "_t"}, exclusive=True)
    opened = previous.withColumn(
        "_open",
        F.when(
            F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= F.lit(gap_seconds * 1_000_000).cast("long")),
            F.col("_ts"),
        ),
    ).drop("_prev")
    labelled = scan(opened, ["_t"], keys, lasts={"session_start": "_open"})
    return labelled.groupBy(*keys, "session_start").agg(
        F.max("_ts").alias("session_last"), F.sum("_n").alias("hits")
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key equals a null key; the keys of ``left`` stay."""
    other = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"_same_{k}" for k in keys])
