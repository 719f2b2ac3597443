"""Ordered scans against plain Python, with a key that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.plans import ordering as O
from duskwatch.plans.selection import percentiles


@pytest.fixture(scope="module")
def hot(spark):
    """Three quarters of the rows belong to one key; one key is null."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        key = "hot" if rng.random() < 0.75 else rng.choice(["a", "b", None])
        rows.append((key, rng.randrange(10**6), i, rng.choice([None, i]), rng.randrange(5)))
    return rows, spark.createDataFrame(rows, "k STRING, t BIGINT, id BIGINT, v BIGINT, n BIGINT").repartition(4)


def _by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_row_index_within_keys(hot):
    rows, df = hot
    found = {r["id"]: r["idx"] for r in O.row_index(df, ["t", "id"], ["k"]).collect()}
    expected = {r[2]: i for group in _by_key(rows).values() for i, r in enumerate(group)}
    assert found == expected


def test_row_index_without_keys(hot):
    rows, df = hot
    found = {r["id"]: r["idx"] for r in O.row_index(df, ["t", "id"]).collect()}
    assert found == {r[2]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}


def test_hot_key_spans_partitions(hot):
    """The partition that scans the hot key holds a fraction of its rows."""
    rows, df = hot
    laid = O._ranged(df, ["k", "t", "id"], 8)
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < len(rows) / 4


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_sums_and_lasts(hot, exclusive):
    rows, df = hot
    got = O.scan(df, ["t", "id"], ["k"], sums={"s": "n"}, lasts={"last": "v"}, exclusive=exclusive)
    found = {r["id"]: (r["s"], r["last"]) for r in got.collect()}
    for group in _by_key(rows).values():
        total, last = 0, None
        for row in group:
            if exclusive:
                assert found[row[2]] == (total, last)
            total += row[4]
            last = row[3] if row[3] is not None else last
            if not exclusive:
                assert found[row[2]] == (total, last)


def test_lookback_counts_match_brute_force(spark):
    rng = random.Random(5)
    times = [("hot", rng.randrange(2000)) for _ in range(600)] + [("b", rng.randrange(2000)) for _ in range(50)]
    df = spark.createDataFrame(times, "k STRING, s BIGINT").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    found = {(r["k"], int(r["ts"].timestamp())): r["hits"] for r in O.lookback_counts(df, ["k"], "ts", 100).collect()}
    base = int(__import__("datetime").datetime(1970, 1, 1).timestamp())
    for key, second in set(times):
        expected = sum(1 for k, s in times if k == key and second - 100 <= s <= second)
        assert found[(key, second + base)] == expected


def test_sessions_merge_close_rows(spark):
    rows = [("a", 0), ("a", 50), ("a", 50), ("a", 200), ("b", 10)]
    df = spark.createDataFrame(rows, "k STRING, s BIGINT").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    found = sorted((r["k"], r["hits"]) for r in O.sessions(df, ["k"], "ts", 100).collect())
    assert found == [("a", 1), ("a", 3), ("b", 1)]


def test_blocks_carry_only_the_edge(spark):
    df = spark.range(25).withColumnRenamed("id", "idx")
    out = O.blocks(df, "idx", 3, 10)
    assert out.filter("_own").count() == 25
    assert sorted(r["idx"] for r in out.filter("NOT _own AND _block = 1").collect()) == [7, 8, 9]
    ahead = O.blocks(df, "idx", 3, 10, ahead=True)
    assert sorted(r["idx"] for r in ahead.filter("NOT _own AND _block = 0").collect()) == [10, 11, 12]
    with pytest.raises(ValueError):
        O.blocks(df, "idx", 11, 10)


def test_checkpoints_use_the_session_folder(spark):
    from duskwatch.session import shared_dir

    assert spark.sparkContext.getCheckpointDir() == shared_dir(spark)


def test_percentiles_match_with_null_keys_and_values(spark, hot):
    import numpy as np

    rows, df = hot
    shares = {"a": 0.25, "b": 0.5, "c": 0.95}
    one = percentiles(df, "t", shares).first()
    values = np.array([r[1] for r in rows], dtype=float)
    assert [one[n] for n in shares] == pytest.approx([np.percentile(values, 100 * q) for q in shares.values()])
    by_key = percentiles(df, "t", shares, ["k"]).collect()
    assert {r["k"] for r in by_key} == {r[0] for r in rows}
    for row in by_key:
        mine = np.array([r[1] for r in rows if r[0] == row["k"]], dtype=float)
        assert [row[n] for n in shares] == pytest.approx([np.percentile(mine, 100 * q) for q in shares.values()])


def test_hash_sample_is_exact(spark):
    from duskwatch.operators.features import hash_sample

    df = spark.range(5000)
    ranked = df.selectExpr("id", "md5(CAST(id AS STRING)) AS h").orderBy("h").limit(50)
    assert {r["id"] for r in hash_sample(df, "id", 50).collect()} == {r["id"] for r in ranked.collect()}


def test_percentiles_of_a_key_without_values_are_null(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "k STRING, v DOUBLE")
    found = {r["k"]: r["m"] for r in percentiles(df, "v", {"m": 0.5}, ["k"]).collect()}
    assert found == {"a": 1.0, None: 2.0, "b": None}
