from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from duskwatch.operators import rules as R
from duskwatch.sources import sinks as S
from duskwatch.streaming import detect as D
from duskwatch.streaming import state

NOW = datetime(2024, 5, 1, 12, 0, 0)


def _folder(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_alerts_merge_within_the_gap(spark, tmp_path):
    schema = "timestamp TIMESTAMP_NTZ, source_ip STRING, anomaly_type STRING"
    rows = [(NOW + timedelta(minutes=m), "1.1.1.1", "xss") for m in (0, 5, 12, 40)] + [(NOW + timedelta(days=1), "2.2.2.2", "xss")]
    stream = _folder(spark, str(tmp_path / "in"), rows, schema)
    D.run_to_table(D.merged_alerts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("session_start").collect()
    assert [(r["source_ip"], r["alerts"]) for r in found] == [("1.1.1.1", 3), ("1.1.1.1", 1)]


def test_distinct_rule_exact_and_approximate(spark, tmp_path):
    schema = "timestamp TIMESTAMP_NTZ, event_type STRING, user STRING, source_ip STRING"
    rows = [(NOW + timedelta(seconds=i), "invalid_user", f"u{i % 5}", "1.1.1.1") for i in range(50)]
    rows += [(NOW, "invalid_user", None, "2.2.2.2"), (NOW + timedelta(days=1), "invalid_user", "x", "3.3.3.3")]
    for approximate in (False, True):
        stream = _folder(spark, str(tmp_path / f"in{approximate}"), rows, schema)
        found = D.windowed_rule(stream, R.SSH_USER_ENUMERATION, approximate=approximate)
        out = str(tmp_path / f"out{approximate}")
        D.run_to_table(found, out, str(tmp_path / f"state{approximate}"))
        (row,) = spark.read.parquet(out).collect()
        assert (row["source_ip"], row["users"]) == ("1.1.1.1", 5)


def _files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_dir())


def test_repeated_batches_do_not_count_twice(spark, tmp_path):
    """A batch that runs again builds on the version before its own; two versions are kept."""
    folder = tmp_path / "stats"
    scores = spark.createDataFrame([("knn", 0.5), ("knn", 0.1)], "method STRING, score DOUBLE")

    def step(state, batch):
        fresh = D.score_stats(batch)
        return fresh if state is None else D.merge_stats(state, fresh)

    merge = state.advance(str(folder), step)
    assert state.latest(spark, str(folder)) is None
    for number in (0, 1, 1, 1, 2, 2, 5, 7):
        merge(scores, number)
    row = state.latest(spark, str(folder)).first()
    assert (row["min"], row["max"], row["count"]) == (0.1, 0.5, 10)
    assert _files(folder) == ["aside", "mark-0", "mark-1", "slot-0", "slot-1"]


def test_state_stays_small_over_many_batches(spark, tmp_path):
    folder = tmp_path / "bank"
    merge = state.advance(str(folder), lambda known, batch: state.newest(batch if known is None else known.unionByName(batch), ["ts", "bank_id"], 4))
    sizes = []
    for number in range(16):
        merge(spark.range(number * 3, number * 3 + 3).select(F.col("id").alias("bank_id"), F.timestamp_seconds("id").alias("ts")).coalesce(1), number)
        sizes.append(sum(1 for p in folder.rglob("*") if p.is_file()))
    assert sorted(r["bank_id"] for r in state.latest(spark, str(folder)).collect()) == list(range(44, 48))
    assert len(_files(folder)) == 4 and sizes[-1] <= sizes[3]


def test_newest_rows_with_ties(spark):
    rows = [(i, NOW + timedelta(hours=i // 10)) for i in range(35)] + [(34, NOW + timedelta(hours=3))] * 4 + [(99, None)]
    df = spark.createDataFrame(rows, "bank_id BIGINT, ts TIMESTAMP").repartition(3)
    for limit in (1, 3, 4, 5, 12, 39, 40, 100):
        found = [r["bank_id"] for r in state.newest(df, ["ts", "bank_id"], limit).collect()]
        expected = sorted(rows, key=lambda r: (r[1] is not None, r[1] or NOW, r[0]))[-limit:]
        assert sorted(found) == sorted(r[0] for r in expected)


def test_every_late_row_is_kept_however_long_the_stream_runs(spark, tmp_path):
    """One early row in each of many batches; a batch that runs twice writes its rows once."""
    schema = "timestamp TIMESTAMP_NTZ, id BIGINT"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number in range(6):
        rows = [(NOW + timedelta(hours=number), number), (NOW - timedelta(days=1), 100 + number), (None, 200 + number)]
        stream = _folder(spark, source, rows, schema)
        D.split_late(stream, out, checkpoint=checkpoint)
    fields = spark.createDataFrame([], schema).schema
    late = D.side(spark, out, "late", fields).collect()
    assert sorted((r["id"], r["batch"]) for r in late) == [(100 + n, n) for n in range(1, 6)]
    assert sorted(r["id"] for r in D.side(spark, out, "on-time", fields).collect()) == [0, 1, 2, 3, 4, 5, 100, 200, 201, 202, 203, 204, 205]


def test_new_rows_are_numbered_on(spark):
    rows = spark.createDataFrame([("b",), ("a",), ("c",)], "line STRING")
    assert {r["line"]: r["id"] for r in S.with_ids(rows, ["line"], first=11).collect()} == {"a": 11, "b": 12, "c": 13}
