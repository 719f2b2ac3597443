"""Order statistics, pages and sample marks against sorted lists."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators.features import mark_sample
from duskwatch.operators.records import page
from duskwatch.plans.selection import bound_at, percentiles, rows_between, values_at

SHARES = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.951, "e": 1.0}


def _frame(spark, values, kind="DOUBLE"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(4)


def test_values_at_matches_sorting(spark):
    """Heavy ties, values of very different size, and infinities."""
    draw = random.Random(1)
    values = [draw.gauss(0, 1) * 10 ** draw.randint(-12, 12) for _ in range(3000)] + [0.25] * 900
    values += [float("inf"), float("-inf"), 1.7e308, -1.7e308, float("nan")]
    ordered = sorted(values, key=lambda v: (math.isnan(v), v))
    ranks = [0, 1, 2, 1500, 1700, len(values) - 3, len(values) - 2, len(values) - 1, len(values), -1]
    found = values_at(_frame(spark, values + [None, None]), "v", ranks)
    assert set(found) == set(ranks[:-2])
    for rank, place in found.items():
        value = ordered[rank]
        if math.isnan(value):
            assert math.isnan(place.value) and place.below == rank
            continue
        assert place.value == value
        assert place.below == sum(v < value for v in values) and place.equal == values.count(value)


def test_whole_numbers_are_told_apart(spark):
    """Neighbouring 64-bit numbers that are one double."""
    values = [(1 << 62) + i for i in range(50)] + [-(1 << 63), (1 << 63) - 1]
    found = values_at(_frame(spark, values, "BIGINT"), "v", range(52))
    assert [found[i].value for i in range(52)] == sorted(values)


@pytest.mark.parametrize("keyed", [False, True])
def test_percentiles_match_numpy(spark, keyed):
    draw = np.random.default_rng(5)
    groups = {"x": draw.normal(size=701), "y": draw.exponential(size=20), None: np.array([3.0, 3.0, 4.0]), "z": np.array([])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("z", None), ("x", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE").repartition(5)
    if keyed:
        found = {r["k"]: r for r in percentiles(df, "v", SHARES, ["k"]).collect()}
        assert set(found) == set(groups)
    else:
        found = {None: percentiles(df, "v", SHARES).first()}
        groups = {None: np.array([v for _, v in rows if v is not None])}
    for key, values in groups.items():
        for name, share in SHARES.items():
            expected = np.quantile(values, share) if len(values) else None
            assert found[key][name] == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_percentiles_of_nothing(spark):
    assert percentiles(_frame(spark, []), "v", {"p": 0.5}).collect()[0]["p"] is None
    empty = spark.createDataFrame([], "k STRING, v DOUBLE")
    assert percentiles(empty, "v", {"p": 0.5}, ["k"]).collect() == []


def test_pages_of_a_listing_with_ties(spark):
    """Times shared by many rows, null times first, ids decide."""
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(hours=i % 7) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id BIGINT, at TIMESTAMP").repartition(6)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or day, r[0]))
    for number, size in ((1, 25), (7, 50), (8, 50), (9, 50), (40, 10), (1, 1000)):
        found = page(df, ["at", "id"], number, size).collect()
        assert [r["id"] for r in found] == [r[0] for r in ordered[(number - 1) * size : number * size]]
        assert all(r["total"] == 400 for r in found)


def test_pages_of_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)] * 30, "v BIGINT")
    assert [r["v"] for r in rows_between(df, ["v"], 25, 10).collect()] == [1] * 5 + [2] * 5
    assert bound_at(df, ["v"], 42) == ([2], 12)


def test_pages_by_text(spark):
    df = spark.createDataFrame([(w,) for w in "delta alpha charlie bravo".split()], "w STRING")
    assert [r["w"] for r in page(df, ["w"], 2, 2).orderBy("w").collect()] == ["charlie", "delta"]


def test_marks_are_exact_with_repeated_keys(spark):
    """A third of the rows share one key; marks do not depend on the partitioning."""
    keys = list(range(200)) + [7] * 100
    for ratio in (0.0, 0.1, 0.5, 0.77, 1.0):
        df = spark.createDataFrame([(k,) for k in keys], "k BIGINT")
        counts = [
            {(r["k"], r["chosen"]): r["n"] for r in mark_sample(part, "k", ratio).groupBy("k", "chosen").agg(F.count(F.lit(1)).alias("n")).collect()}
            for part in (df.repartition(3), df.repartition(7))
        ]
        assert counts[0] == counts[1]
        assert sum(n for (_, chosen), n in counts[0].items() if chosen) == int(300 * ratio)
