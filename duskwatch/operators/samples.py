"""Samples by the hash of a key: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest key hash (all rows when there are fewer).

    A large table is first cut at a hash bound that keeps a few times ``limit``
    rows, so that the final ordering does not receive ``limit`` rows from every
    partition. The bound is raised until enough rows lie below it, which keeps
    the choice exact.
    """
    digest = F.md5(F.col(key).cast("string"))
    total = rows.count()
    kept, share = rows, 4.0 * limit / max(total, 1)
    while share < 1.0:
        bound = f"{int(share * 16**8):08x}"
        below = rows.filter(digest < F.lit(bound))
        if below.select(key).count() >= limit:
            kept = below
            break
        share *= 2
    return kept.orderBy(digest, key).limit(limit)
