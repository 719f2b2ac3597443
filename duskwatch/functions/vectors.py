"""Vector columns held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.functions.predicates import col


def dot(a: str | Column, b: str | Column) -> Column:
    pairs = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a: str | Column, b: str | Column) -> Column:
    squares = F.zip_with(
        col(a), col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(a: str | Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(col(a), lambda x: x.cast("double") / norm)).otherwise(
        F.transform(col(a), lambda x: x.cast("double"))
    )


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ip_number(ip: str | Column) -> Column:
    """IPv4 text as a number; null where a part is missing or above 255."""
    parts = F.split(col(ip), r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("long") for i in range(1, 5)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    valid = (F.size(parts) == 4) & (F.greatest(*octets) <= 255) & (F.least(*octets) >= 0)
    return F.when(valid, value)
