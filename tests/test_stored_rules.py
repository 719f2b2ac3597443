"""Rules kept as SQL: what becomes a condition of one scan, what stays a query, what fails."""

from __future__ import annotations

import pytest

from duskwatch.operators.stored_rules import compile_rules, run_stored_rules

RULES = "rule_id BIGINT, name STRING, description STRING, sql_query STRING"


@pytest.fixture(scope="module")
def tables(spark):
    logs = spark.createDataFrame(
        [(1, "login", "a"), (2, "failed_login", None), (3, "failed_login", "b"), (4, None, "where")], "log_id BIGINT, event_type STRING, message STRING"
    )
    return {"logs": logs}


def _rules(spark, *texts):
    return spark.createDataFrame([(i, f"r{i}", None, t) for i, t in enumerate(texts)], RULES)


def test_one_scan_serves_all_conditions(spark, tables, tmp_path):
    stored = str(tmp_path / "logs")
    tables["logs"].write.parquet(stored)
    rules = _rules(
        spark,
        "SELECT log_id FROM logs WHERE event_type = 'failed_login'",
        "select * from LOGS\n where message like '%where%';",
        "SELECT log_id FROM logs",
        "SELECT logs.log_id FROM logs WHERE event_type <> 'login' OR message IS NULL",
    )
    hits, failures = run_stored_rules(rules, {"logs": spark.read.parquet(stored)})
    assert sorted((r["rule_id"], r["log_id"]) for r in hits.collect()) == [
        (0, 2), (0, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 2), (3, 3)
    ]
    assert failures.count() == 0
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_more_than_a_condition_stays_a_query(spark, tables):
    rules = _rules(
        spark,
        "SELECT max(log_id) AS log_id FROM logs GROUP BY event_type",
        "SELECT log_id FROM logs WHERE log_id > 1 ORDER BY log_id LIMIT 1",
        "SELECT a.log_id FROM logs a JOIN logs b ON a.log_id = b.log_id + 1",
    )
    compiled = compile_rules(rules, tables)
    assert not compiled.conditions and [i for i, _ in compiled.queries] == [0, 1, 2]
    hits, _ = run_stored_rules(rules, tables)
    assert sorted((r["rule_id"], r["log_id"]) for r in hits.collect()) == [(0, 1), (0, 3), (0, 4), (1, 2), (2, 2), (2, 3), (2, 4)]


def test_rules_that_cannot_run_are_rows(spark, tables):
    rules = _rules(spark, "SELECT log_id FROM nowhere", "SELECT log_id FROM logs WHERE nothing = 1", "no SQL", None, "SELECT log_id FROM logs")
    hits, failures = run_stored_rules(rules, tables)
    assert {r["rule_id"] for r in hits.collect()} == {4}
    rows = failures.orderBy("rule_id").collect()
    assert [r["rule_id"] for r in rows] == [0, 1, 2, 3] and all(r["error"] for r in rows)
    assert rows[0]["error"] == "TABLE_OR_VIEW_NOT_FOUND"


def test_no_rules(spark, tables):
    hits, failures = run_stored_rules(_rules(spark, "x").limit(0), tables)
    assert hits.count() == 0 and failures.count() == 0


def test_many_rules_of_one_table(spark, tables):
    rules = _rules(spark, *[f"SELECT log_id FROM logs WHERE log_id % 5 = {i % 5}" for i in range(450)])
    hits, _ = run_stored_rules(rules, tables)
    assert hits.count() == 4 * 90
