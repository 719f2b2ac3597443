"""Order statistics by refining histograms: nothing is sorted and no row is moved.

The range of the values is cut into bins, the rows are counted per bin, and the
bins that hold a wanted rank are cut again between the smallest and the largest
value seen in them, until such a bin holds one value. A round is one aggregation
with a bounded number of groups; every round cuts the range of a bin by a factor
of ``BINS``, so few rounds are needed whatever the number of rows. Rows are read
once a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.plans.ordering import freeze, same_keys

BINS = 2048
# State of a round that is small enough for every task: one row per key.
BROADCAST_KEYS = 100_000

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def sortable(rows: DataFrame, name: str) -> Column:
    """A number that orders like the column: whole, or a double."""
    kind = rows.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, _WHOLE):
        return column.cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_timestamp_ltz(column))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.cast("double")
    raise TypeError(f"{name}: values of type {kind.simpleString()} cannot be put into bins")


def has_bins(rows: DataFrame, names: Sequence[str]) -> bool:
    kinds = (*_WHOLE, T.TimestampType, T.TimestampNTZType, T.DateType, T.DoubleType, T.FloatType)
    return all(isinstance(rows.schema[n].dataType, kinds) for n in names)


def _bin(v: Column, low: Column, high: Column, whole: bool) -> Column:
    """Bin of a value between ``low`` and ``high``; never falls as the value grows.

    The lowest value is in the first bin and the highest in the last, so two
    different values are always told apart in the end.
    """
    if whole:
        wide = lambda c: c.cast("decimal(20,0)")
        place = (wide(v) - wide(low)).cast("double") / (wide(high) - wide(low)).cast("double")
        return F.when(low == high, 0).otherwise(F.floor(place * (BINS - 1)))
    # halves, as the whole range may be beyond a double
    place = (v / 2 - low / 2) / (high / 2 - low / 2)
    inside = F.when(low == high, 0).otherwise(F.floor(place * (BINS - 1)))
    return (
        F.when(v == float("-inf"), -1).when(F.isnan(v), BINS + 1).when(v == float("inf"), BINS).otherwise(inside)
    )


def _finite(v: Column, whole: bool) -> Column:
    return v if whole else F.when(F.abs(v) < float("inf"), v)


@dataclass
class Place:
    """The value at a rank, how many values are smaller, and how many are equal."""

    value: float | int
    below: int
    equal: int


def values_at(rows: DataFrame, column: str, ranks: Sequence[int] | Callable[[int], Sequence[int]]) -> dict[int, Place]:
    """The values at zero-based ``ranks`` of the non-null values in rising order (NaN comes last).

    Ranks outside the table have no entry. ``ranks`` may be a function of the
    number of values.
    """
    v = sortable(rows, column)
    whole = isinstance(rows.select(v.alias("v")).schema["v"].dataType, T.LongType)
    narrow = rows.select(v.alias("v")).filter("v IS NOT NULL")
    total, low, high = narrow.agg(F.count("v"), F.min(_finite(F.col("v"), whole)), F.max(_finite(F.col("v"), whole))).first()
    wanted = sorted({r for r in (ranks(total) if callable(ranks) else ranks) if 0 <= r < total})
    spans = [(low, high, 0, wanted)] if wanted else []
    found: dict[int, Place] = {}
    kind = "bigint" if whole else "double"
    shape = f"struct<at:int,low:{kind},high:{kind}>"
    everything = True
    while spans:
        places = F.array(*[F.struct(F.lit(i), F.lit(low), F.lit(high)).cast(shape) for i, (low, high, _, _) in enumerate(spans)])
        inside = places if everything else F.filter(places, lambda s: F.col("v").between(s["low"], s["high"]))
        counted = (
            narrow.withColumn("s", F.get(inside, F.lit(0)))
            .filter("s IS NOT NULL")
            .groupBy(F.col("s.at").alias("span"), _bin(F.col("v"), F.col("s.low"), F.col("s.high"), whole).cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )  # at most BINS and a few rows for each span
        reached = {i: s[2] for i, s in enumerate(spans)}
        following = []
        for r in sorted(counted, key=lambda r: (r["span"], r["bin"])):
            start = reached[r["span"]]
            reached[r["span"]] = start + r["n"]
            hit = [k for k in spans[r["span"]][3] if start <= k < start + r["n"]]
            if hit and (r["low"] == r["high"] or _is_nan(r["low"])):
                found.update({k: Place(r["low"], start, r["n"]) for k in hit})
            elif hit:
                following.append((r["low"], r["high"], start, hit))
        spans, everything = following, False
    return found


def _is_nan(value) -> bool:
    return isinstance(value, float) and math.isnan(value)


def _keyed_values(rows: DataFrame, column: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rank, value`` for ``wanted(keys, low, high, ranks)``: the same rounds for all keys at once.

    A round counts per key and bin; its state is one row per key with the few
    bins that still hold a wanted rank.
    """
    span = "struct<low:double,high:double,first:bigint,ranks:array<bigint>>"
    state = freeze(
        wanted.filter(F.size("ranks") > 0).select(
            *keys, F.array(F.struct("low", "high", F.lit(0).cast("bigint").alias("first"), "ranks").cast(span)).alias("_spans")
        )
    )
    found, first = None, True
    narrow = rows.select(*keys, F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    while True:
        open_keys = state.count()
        if open_keys == 0 and found is not None:
            return found
        small = F.broadcast(state) if open_keys <= BROADCAST_KEYS else state
        v = F.col("_v")
        holds = F.get("_spans", F.lit(0)) if first else F.get(
            F.filter("_spans", lambda s: (v >= s["low"]) & (v <= s["high"])), F.lit(0)
        )
        tagged = same_keys(narrow, small, keys).select(*keys, "_v", holds.alias("_s")).filter(F.col("_s").isNotNull())
        binned = _bin(v, F.col("_s.low"), F.col("_s.high"), False).cast("bigint")
        counted = tagged.groupBy(*keys, "_s", binned.alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        upto = Window.partitionBy(*keys, "_s").orderBy("_b")  # BINS rows and a few
        placed = counted.withColumn("_end", F.col("_s.first") + F.sum("_n").over(upto)).withColumn(
            "_ranks", F.filter(F.col("_s.ranks"), lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))
        )
        hits = freeze(placed.filter(F.size("_ranks") > 0))
        single = F.col("_low") == F.col("_high")
        closed = hits.filter(single).select(*keys, F.explode("_ranks").alias("rank"), F.col("_low").alias("value"))
        found = closed if found is None else found.unionByName(closed)
        state = freeze(
            hits.filter(~single)
            .groupBy(*keys)
            .agg(
                F.collect_list(
                    F.struct(
                        F.col("_low").alias("low"),
                        F.col("_high").alias("high"),
                        (F.col("_end") - F.col("_n")).alias("first"),
                        F.col("_ranks").alias("ranks"),
                    ).cast(span)
                ).alias("_spans")
            )
        )
        first = False


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key (a null key is a key).

    A key without a value has null percentiles; without keys there is one row.
    Infinite values and NaN (which comes last) are values like others.
    """
    keys = list(keys)
    if not keys:
        spots: dict[str, float] = {}

        def around(total: int) -> list[int]:
            spots.update({n: (total - 1) * q for n, q in shares.items()})
            return [f(spot) for spot in spots.values() for f in (math.floor, math.ceil)]

        known = {r: float(place.value) for r, place in values_at(rows, column, around).items()}
        values = []
        for spot in spots.values():
            low, high = known.get(math.floor(spot)), known.get(math.ceil(spot))
            values.append(low if low is None or spot == math.floor(spot) else low + (high - low) * (spot - math.floor(spot)))
        schema = T.StructType([T.StructField(n, T.DoubleType()) for n in shares])
        return rows.sparkSession.createDataFrame([tuple(values)], schema)
    v = F.col(column).cast("double")
    finite = F.when(F.abs(v) < float("inf"), v)
    totals = rows.groupBy(*keys).agg((F.count(column) - 1).alias("_last"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    spots = [f(F.col("_last") * q).cast("bigint") for q in shares.values() for f in (F.floor, F.ceil)]
    ranks = F.when(F.col("_last") >= 0, F.array_distinct(F.array(*spots))).otherwise(F.array().cast("array<bigint>"))
    totals = freeze(totals.withColumn("ranks", ranks))
    found = _keyed_values(rows, column, totals, keys)
    listed = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    both = same_keys(totals.select(*keys, "_last"), listed, keys, "left")
    out = []
    for name, share in shares.items():
        spot = F.col("_last") * F.lit(share)
        low, high = F.floor(spot).cast("bigint"), F.ceil(spot).cast("bigint")
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        out.append(F.when(low == high, a).otherwise(a + (b - a) * (spot - F.floor(spot))).alias(name))
    return both.select(*keys, *out)


def bound_at(rows: DataFrame, order: Sequence[str], rank: int) -> tuple[list, int]:
    """The values of ``order`` at a zero-based rank, nulls first, and how many rows equal them lie before it.

    Column by column: the value at the rank, then the rank among the rows that
    share it. ``rank`` must lie inside the table.
    """
    values: list = []
    for name in order:
        v = sortable(rows, name)
        nulls = rows.filter(v.isNull()).count()
        if rank < nulls:
            values.append(None)
            rows = rows.filter(v.isNull())
            continue
        place = values_at(rows, name, [rank - nulls])[rank - nulls]
        values.append(place.value)
        rank = rank - nulls - place.below
        if place.equal == 1:
            break
        rows = rows.filter(v == F.lit(place.value))
    return values, rank


def before(rows: DataFrame, order: Sequence[str], values: Sequence) -> Column:
    """Whether a row comes strictly before ``values`` in ``order`` (nulls first)."""
    out = F.lit(False)
    for name, value in reversed(list(zip(order, values))):
        v = sortable(rows, name)
        if value is None:
            out = v.isNull() & out
        else:
            out = F.coalesce(v < F.lit(value), F.lit(True)) | ((v == F.lit(value)) & out)
    return F.coalesce(out, F.lit(False))


def among_first(rows: DataFrame, order: Sequence[str], values: Sequence) -> Column:
    """Whether a row comes before ``values`` or equals them."""
    same = F.lit(True)
    for name, value in zip(order, values):
        same = same & sortable(rows, name).eqNullSafe(F.lit(value))
    return before(rows, order, values) | same


def rows_between(rows: DataFrame, order: Sequence[str], first: int, size: int) -> DataFrame:
    """The rows at the ranks ``first`` to ``first + size - 1`` of ``order``, without sorting the table.

    Rows equal in all of ``order`` are interchangeable. Only the rows around the
    two bounds are put in order.
    """
    total = rows.count()
    last = min(first + size, total) - 1
    if size <= 0 or first >= total or first < 0:
        return rows.limit(0)
    start, ahead = bound_at(rows, order, first)
    end, _ = bound_at(rows, order, last)
    kept = rows.filter(~before(rows, order, start) & among_first(rows, order, end))
    columns = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    return kept.orderBy(*columns).offset(ahead).limit(last - first + 1)
