from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from duskwatch.operators import questions as N
from duskwatch.operators import records as Q
from duskwatch.schemas import TABLES
from duskwatch.sources import sinks as S

NOW = datetime(2024, 5, 15, 12, 0, 0)  # a Wednesday


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        (1, NOW - timedelta(hours=2), "192.168.1.1", "login", "m", None, "none", NOW),
        (2, NOW - timedelta(hours=1), "192.168.1.2", "logout", "m", None, "none", NOW),
        (3, NOW, "192.168.1.1", "login", "m", None, "AI", NOW),
    ]
    return spark.createDataFrame(rows, TABLES["logs"])


def test_filters(logs):
    assert Q.filter_logs(logs, source_ip="192.168.1.1").count() == 2
    assert Q.filter_logs(logs, event_type="login").count() == 2
    assert Q.filter_logs(logs, detected_by="AI").count() == 1
    assert Q.filter_logs(logs, start=NOW - timedelta(hours=1.5)).count() == 2
    assert Q.filter_logs(logs, end=NOW - timedelta(hours=1)).count() == 2
    assert [r["log_id"] for r in Q.newest_first(logs).collect()] == [3, 2, 1]


def test_new_logs_are_validated(spark):
    rows = [("192.168.1.1", "login", "m", None), ("invalid.ip", "login", "m", "rules"), ("1.1.1.1", None, "m", "bad")]
    valid, rejected = S.validate_logs(spark.createDataFrame(rows, "source_ip STRING, event_type STRING, message STRING, detected_by STRING"))
    (row,) = valid.collect()
    assert row["detected_by"] == "none" and row["timestamp"] is not None
    reasons = {r["source_ip"]: r["reject_reasons"] for r in rejected.collect()}
    assert reasons == {"invalid.ip": ["Invalid IP address format"], "1.1.1.1": ["missing event_type", "Invalid status"]}


def test_status_updates(spark, logs):
    updates = spark.createDataFrame([(1, "rules"), (1, "AI"), (2, "rules")], "log_id BIGINT, detected_by STRING")
    found = {r["log_id"]: r["detected_by"] for r in S.update_status(logs, updates).collect()}
    assert found == {1: "both", 2: "rules", 3: "AI"}
    with pytest.raises(PySparkException, match="Invalid status"):
        S.update_status(logs, spark.createDataFrame([(1, "invalid_status")], "log_id BIGINT, detected_by STRING")).collect()


def test_rules_need_unique_names(spark):
    rows = [(1, "a", None, "q", None, None), (2, "b", None, "q", "block", None), (3, "b", None, "q", "log", None), (4, "c", None, "q", "ban", None)]
    valid, rejected = S.validate_rules(spark.createDataFrame(rows, TABLES["rules"]))
    assert [(r["rule_id"], r["action"]) for r in valid.collect()] == [(1, "alert")]
    assert rejected.count() == 3


def test_append_keeps_days_apart(spark, logs, tmp_path):
    path = str(tmp_path / "logs")
    S.append_table(logs, path)
    S.append_table(logs, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 6 and stored.select("dt").distinct().count() == 1


def test_correlation_counts_pairs(spark):
    left = spark.createDataFrame([("a", NOW), ("a", NOW + timedelta(hours=3))], "ip STRING, timestamp TIMESTAMP_NTZ")
    right = spark.createDataFrame([("a", NOW + timedelta(minutes=m)) for m in (-60, 10, 60, 61)] + [("b", NOW)], "ip STRING, timestamp TIMESTAMP_NTZ")
    found = {r["timestamp"]: r["matches"] for r in Q.correlate(left, right, "ip", 3600).collect()}
    assert found == {NOW: 3, NOW + timedelta(hours=3): 0}


# --- questions -----------------------------------------------------------------


def _intent(spark, text):
    return N.read_intent(spark.createDataFrame([(text,)], "question STRING"), NOW).first()


def test_time_phrases(spark):
    row = _intent(spark, "最近24小时的登录失败")
    assert (row["time_type"], row["time_unit"], row["time_value"]) == ("relative", "hour", 24)
    row = _intent(spark, "今天的异常事件")
    assert (row["time_type"], row["time_start"], row["time_end"]) == ("special", datetime(2024, 5, 15), datetime(2024, 5, 15, 23, 59, 59))
    row = _intent(spark, "上周的日志")
    assert (row["time_start"], row["time_end"]) == (datetime(2024, 5, 6), datetime(2024, 5, 12, 23, 59, 59))
    row = _intent(spark, "上个月的日志")
    assert (row["time_start"], row["time_end"]) == (datetime(2024, 4, 1), datetime(2024, 4, 30, 23, 59, 59))
    row = _intent(spark, "从2024年1月5日到2024/01/09 12:30之间的日志")
    assert (row["time_type"], row["time_start"], row["time_end"]) == ("absolute", datetime(2024, 1, 5), datetime(2024, 1, 9, 12, 30))
    row = _intent(spark, "3天前的日志")
    assert (row["time_unit"], row["time_value"]) == ("day", 3)


def test_entities(spark):
    assert _intent(spark, "用户admin的登录记录")["user"] == "admin"
    assert _intent(spark, "root用户的操作")["user"] == "root"
    assert _intent(spark, "来自IP 192.168.1.100的请求")["ip"] == "192.168.1.100"
    row = _intent(spark, "最近登录失败的记录")
    assert (row["event"], row["status"], row["kind"]) == ("login", "failure", "login_failures")
    assert _intent(spark, "前10条日志")["row_limit"] == 10
    assert _intent(spark, "日志")["row_limit"] == 100


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("最近24小时admin登录失败次数", ["login_failures", "logs"]),
        ("最近12小时的异常事件", ["anomalies", "logs"]),
        ("恶意行为日志", ["logs", "anomalies"]),
        ("查看所有规则", ["rules", "logs"]),
        ("最近6小时的日志", ["logs"]),
    ],
)
def test_template_choice(spark, text, kinds):
    assert list(_intent(spark, text)["kinds"]) == kinds


def test_spellings_match_the_unpruned_list(spark):
    texts = ["user=admin x", "ADMIN_user", "nothing", "login ok", "auth failure", "logged in", "event=login", "denied"]
    rows = spark.createDataFrame([(t, None, "other") for t in texts], "message STRING, user STRING, event_type STRING")
    for kind, value in (("user", "admin"), ("event_type", "login"), ("event_type", "failure")):
        found = {r["message"] for r in rows.filter(N.mentions(kind, value)).collect()}
        expected = {t for t in texts if any(p.lower() in t.lower() for p in N.spellings(kind, value))}
        assert found == expected


def test_answer_runs_the_chosen_template(spark, logs):
    rules = spark.createDataFrame([(1, "r", None, "q", "alert", NOW)], TABLES["rules"])
    anomalies = spark.createDataFrame([(7, 1, 1, "rules", None, 0.5, "xss", "", NOW)], TABLES["anomalies"])
    intent = _intent(spark, "合并最近3小时的异常和日志").asDict()
    out = N.answer(intent, logs, anomalies, rules, NOW)
    assert out.columns[0] == "id" and len(out.columns) == 6 and out.count() == 4
    assert N.answer({"kinds": ["rules"]}, logs, anomalies, rules, NOW).first()["entity_name"] == "r"


def test_sensitive_logins_with_unknown_sources(spark):
    logs = spark.createDataFrame(
        [(1, "root", "10.0.0.1"), (2, "root", "10.0.0.2"), (3, "admin", None), (4, "guest", "10.0.0.2"), (5, None, None)],
        "log_id int, user string, source_ip string",
    )
    allowed = spark.createDataFrame([("10.0.0.1",), ("10.0.0.1",), (None,)], "source_ip string")
    found = Q.sensitive_logins(logs, ["root", "admin"], allowed)
    assert sorted(r.log_id for r in found.collect()) == [2, 3]
    nobody = allowed.limit(0)
    assert sorted(r.log_id for r in Q.sensitive_logins(logs, ["root", "admin"], nobody).collect()) == [1, 2, 3]
