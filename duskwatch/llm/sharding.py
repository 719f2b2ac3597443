"""Shards of near equal size from sampled splitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from duskwatch.llm.common import freeze, stored

RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 32


def _range_of(key: Column, splitters: Column, count: int) -> Column:
    """How many of the sorted ``splitters`` are at most ``key``, by binary search."""
    steps = max(1, count.bit_length())
    zero = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state.lo + state.hi) / 2).cast("int")
        below = F.get(splitters, mid) <= key
        return (
            F.when(state.lo >= state.hi, state)
            .when(below, F.struct((mid + 1).alias("lo"), state.hi.alias("hi")))
            .otherwise(F.struct(state.lo.alias("lo"), mid.alias("hi")))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), zero, halve).lo


def shard_by_bytes(
    rows: DataFrame,
    order: list[str],
    size: str,
    shards: int = 8,
    ranges_per_shard: int = RANGES_PER_SHARD,
    samples_per_range: int = SAMPLES_PER_RANGE,
    seed: int = 17,
) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard).

    Records lie in the order of ``order`` (long columns, nulls first); a row
    number breaks ties, so equal keys may go to any number of ranges. A record is
    sampled with a probability in proportion to its size, and the quantiles of
    the sample cut the keys into ``shards * ranges_per_shard`` ranges of about
    equal size. The size of every range is then counted over all records. A
    range that would overfill its shard is subdivided at the record where the
    shard is full: each record goes to the shard in which its middle falls when
    all records stand in a row, so no shard is off the mean by more than the
    largest record. A record larger than a shard leaves shards empty. Sizes
    must be positive. ``rows`` should be narrow: it is written once to the
    shared folder. An empty table gives no rows.

    The sample (``shards * ranges_per_shard * samples_per_range`` records are
    expected, whatever the input) is all the driver sees.
    """
    base = freeze(rows.withColumn("_row", F.monotonically_increasing_id()))
    key = F.struct(*[F.coalesce(F.col(c), F.lit(-(1 << 63))).alias(c) for c in order], "_row")
    base = base.withColumn("_key", key)
    total = base.agg(F.sum(size)).first()[0]
    ranges = shards * ranges_per_shard
    splitters: list = []
    if total:
        draw = F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        wanted = ranges * samples_per_range
        picked = base.where(draw < F.col(size) * F.lit(wanted / total)).select("_key")
        sample = sorted(tuple(r[0]) for r in picked.collect())
        cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
        splitters = sorted(set(cuts))
    if splitters:
        table = F.array(
            *[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(s, [*order, "_row"])]) for s in splitters]
        )
        base = base.withColumn("_range", _range_of(F.col("_key"), table, len(splitters)))
    else:
        base = base.withColumn("_range", F.lit(0))
    base = stored(base, "ranged")
    per_range = base.groupBy("_range").agg(F.sum(size).alias("_bytes"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select("_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.join(F.broadcast(starts), "_range")
        .withColumn("_at", F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn("shard", F.least(F.expr(f"CAST((2 * _at + {size}) * {shards} DIV {2 * (total or 1)} AS INT)"), F.lit(shards - 1)))
    )
    counts = placed.groupBy("_range", "shard").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_range", "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_range", "shard").orderBy("_key")
    return (
        placed.join(F.broadcast(firsts), ["_range", "shard"])
        .withColumn("slot", F.col("_first") + F.row_number().over(within) - 1)
        .select(*rows.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 8, **parameters) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    The size is that of the text in UTF-8 plus one (null: one). Documents are
    ordered by a hash of the text and then by id, so equal texts stand together
    and a group of them is cut only where a shard is full.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    return shard_by_bytes(narrow, ["_hash", "doc_id"], "size", shards, **parameters).drop("_hash")
