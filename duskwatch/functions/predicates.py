"""Filter predicates as columns."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions import fixed_values as fixed


def col(name_or_col: str | Column) -> Column:
    return F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col


def like_any(column: str | Column, patterns: Iterable[str]) -> Column:
    """Any pattern matches, ignoring ASCII and Unicode case."""
    return reduce(lambda a, b: a | b, [col(column).ilike(p) for p in patterns])


def lower_like_any(column: str | Column, patterns: Iterable[str]) -> Column:
    lowered = F.lower(col(column))
    return reduce(lambda a, b: a | b, [lowered.like(p) for p in patterns])


def contains_any(column: str | Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(column), F.lit(w)) for w in words])


def is_ipv4(column: str | Column) -> Column:
    return col(column).rlike(fixed.IPV4_SHAPE)


def moment(as_of: datetime | str | Column) -> Column:
    """A point in time as a zone-free timestamp literal, which the scan can prune on."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp_ntz")


def since(ts: str | Column, as_of: datetime | str | Column, minutes: int) -> Column:
    """``as_of - minutes <= ts <= as_of``: nothing after ``as_of`` counts, so back-fills are right."""
    end = moment(as_of)
    return (col(ts) >= end - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")) & (col(ts) <= end)


def hour_between(ts: str | Column, first: int, last: int) -> Column:
    return F.hour(col(ts)).between(first, last)


def excludes_all(text: str | Column, words: Iterable[str]) -> Column:
    """True when the text holds none of the words, ignoring case."""
    lowered = F.lower(col(text))
    return reduce(lambda a, b: a & b, [~F.contains(lowered, F.lit(w.lower())) for w in words])


def score_band(score: str | Column, high: float = 0.7, low: float = 0.4) -> Column:
    """high above ``high``, medium above ``low``, else low."""
    return (
        F.when(col(score) > high, "high").when(col(score) > low, "medium").otherwise("low")
    )
