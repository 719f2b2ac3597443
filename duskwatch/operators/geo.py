"""IP-to-country enrichment as a bucketed range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.vectors import ip_number

_NET = 65536  # addresses per /16


def with_country(rows: DataFrame, ranges: DataFrame, ip: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Add ``country`` from ``ranges(ip_start, ip_end, country)``; ranges must not overlap.

    An equi-join on the /16 network with the range as residual; a range over
    several networks is listed under each of them. Spark broadcasts the ranges
    when their size allows, else both sides shuffle on the network and adaptive
    execution splits hot networks.
    """
    spread = ranges.select(
        "ip_start",
        "ip_end",
        "country",
        F.explode(
            F.sequence(F.floor(F.col("ip_start") / _NET), F.floor(F.col("ip_end") / _NET))
        ).alias("_net_of_range"),
    )
    numbered = rows.withColumn("_number", ip_number(ip)).withColumn("_net", F.floor(F.col("_number") / _NET))
    found = numbered.join(
        spread,
        (F.col("_net") == F.col("_net_of_range"))
        & (F.col("_number") >= F.col("ip_start"))
        & (F.col("_number") <= F.col("ip_end")),
        "left",
    )
    return found.drop("_number", "_net", "_net_of_range", "ip_start", "ip_end").withColumn(
        "country", F.coalesce("country", F.lit(unknown))
    )
