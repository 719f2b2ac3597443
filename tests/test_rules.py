from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from duskwatch.operators import rules as R
from duskwatch.schemas import TABLES

NOW = datetime(2024, 5, 1, 12, 0, 0)


def _ssh(spark, rows):
    """rows: (minutes ago, event_type, user, ip)"""
    data = [(i, NOW - timedelta(minutes=m), 1, e, u, ip, 22, None, None) for i, (m, e, u, ip) in enumerate(rows)]
    return spark.createDataFrame(data, TABLES["ssh_logs"])


def test_six_failures_are_brute_force(spark):
    logs = _ssh(spark, [(4, "authentication_failure", "root", "192.168.1.100")] * 6)
    (row,) = R.count_keys(logs, R.SSH_BRUTE_FORCE, NOW).collect()
    assert (row["anomaly_type"], row["source_ip"], row["attempts"]) == ("ssh_brute_force", "192.168.1.100", 6)
    assert row["reason"] == "SSH暴力破解检测：6次失败尝试"


def test_five_failures_are_not(spark):
    logs = _ssh(spark, [(4, "authentication_failure", "root", "1.1.1.1")] * 5)
    assert R.count_keys(logs, R.SSH_BRUTE_FORCE, NOW).count() == 0


def test_old_failures_do_not_count(spark):
    logs = _ssh(spark, [(6, "invalid_user", "root", "1.1.1.1")] * 9 + [(5, "invalid_user", "x", "2.2.2.2")] * 6)
    assert [r["source_ip"] for r in R.count_keys(logs, R.SSH_BRUTE_FORCE, NOW).collect()] == ["2.2.2.2"]


def test_failures_after_the_moment_do_not_count(spark):
    logs = _ssh(spark, [(-m, "authentication_failure", "u", "10.0.0.1") for m in range(1, 8)])
    assert R.run_rules(logs, R.SSH_RULES, NOW).count() == 0


def test_four_users_are_an_enumeration(spark):
    logs = _ssh(spark, [(10, "invalid_user", u, "192.168.1.101") for u in ("alice", "bob", "charlie", "david")])
    (row,) = R.count_keys(logs, R.SSH_USER_ENUMERATION, NOW).collect()
    assert (row["source_ip"], row["users"]) == ("192.168.1.101", 4)


def test_null_sources_form_a_group_and_null_users_do_not_count(spark):
    logs = _ssh(spark, [(1, "invalid_user", None, None)] * 6)
    assert R.count_keys(logs, R.SSH_BRUTE_FORCE, NOW).first()["source_ip"] is None
    assert R.count_keys(logs, R.SSH_USER_ENUMERATION.tuned(threshold=0), NOW).count() == 0


def test_global_rule_gives_one_row_or_none(spark):
    logs = _ssh(spark, [(0, "invalid_user", "u", f"1.1.1.{i}") for i in range(61)])
    (row,) = R.count_keys(logs, R.SSH_GLOBAL_DDOS, NOW).collect()
    assert row["attempts"] == 61
    assert R.count_keys(logs.limit(0), R.SSH_GLOBAL_DDOS, NOW).count() == 0


def test_sources_over_both_limits_get_both_types(spark):
    logs = _ssh(spark, [(0, "other", None, "9.9.9.9")] * 101)
    found = R.run_rules(logs, R.SSH_RULES, NOW).collect()
    assert sorted(r["anomaly_type"] for r in found) == ["high_frequency", "port_scan"]
    assert {r["reason"] for r in found} == {"高频连接: 9.9.9.9 101次/1分钟"}


def test_set_equals_single_rules(spark):
    logs = _ssh(
        spark,
        [(m % 90, e, f"u{m % 5}", f"10.0.0.{m % 3}") for m in range(200) for e in ("invalid_user", "reverse_dns_failure")],
    )
    rules = [r.tuned(threshold=2) for r in R.SSH_RULES]
    together = R.run_rules(logs, rules, NOW).select("anomaly_type", "source_ip", "metric").collect()
    alone = [
        (r[0], r[1], r[2])
        for rule in rules
        for r in R.count_keys(logs, rule, NOW).select("anomaly_type", "source_ip", rule.metric).collect()
    ]
    assert sorted(map(tuple, together)) == sorted(alone)


@pytest.fixture(scope="module")
def web(spark):
    rows = [
        ("GET", "/a?q=1 union select 2", 200, "Mozilla"),
        ("PUT", "/b/../c", 404, "SQLMap/1"),
        (None, "/c?x=<SCRIPT>alert(1)", 401, None),
        ("HEAD", "/wp-admin/x?id=1=1", 200, "Nmap"),
    ]
    data = [(i, NOW, "1.2.3.4", m, p, s, a) for i, (m, p, s, a) in enumerate(rows)]
    return spark.createDataFrame(data, TABLES["web_logs"])


def test_patterns_ignore_case_and_overlap(web):
    found = R.run_rules(web, R.WEB_RULES, NOW).groupBy("anomaly_type").count().collect()
    assert {r["anomaly_type"]: r["count"] for r in found} == {
        "sql_injection": 2, "xss": 1, "directory_traversal": 1, "sensitive_file_access": 1,
        "suspicious_user_agent": 2, "abnormal_http_method": 1,
    }


def test_null_method_is_not_abnormal(web):
    assert [r["method"] for r in R.flag_rows(web, R.WEB_METHOD).collect()] == ["PUT"]


def test_geo_rule_and_unknown_country(spark):
    ranges = spark.createDataFrame([(16843008, 16843263, "AU"), (134744064, 134744319, "US")], "ip_start BIGINT, ip_end BIGINT, country STRING")
    logs = _ssh(spark, [(1, "login_success", "a", "1.1.1.1"), (2, "login_success", "a", "8.8.8.8"), (1, "login_success", "b", "8.8.8.8"), (1, "login_success", "c", "bad"), (1, "login_success", "c", "8.8.8.9"), (90, "login_success", "b", "1.1.1.1")])
    found = {r["user"]: list(r["countries"]) for r in R.geo_anomaly(logs, ranges, NOW).collect()}
    assert found == {"a": ["AU", "US"], "c": ["UNKNOWN", "US"]}


def test_hdfs_reports_the_largest_pid(spark):
    rows = [(i, NOW, p, "WARN", "dfs.A", "x", "E3") for i, p in enumerate([4, 9, 2, 7])]
    logs = spark.createDataFrame(rows, TABLES["hdfs_logs"])
    (row,) = R.count_keys(logs, R.HDFS_SERVICE, NOW).collect()
    assert (row["pid"], row["attempts"]) == (9, 4)
    assert row["reason"] == "组件级暴力操作：组件dfs.A异常4次"


def test_predicates_reach_the_scan(spark, sf):
    """The look-back bound is a literal the parquet scan can use."""
    from duskwatch.catalog.registry import newest
    from duskwatch.catalog.views import view

    df = R.count_keys(view(spark, sf, "ssh_logs"), R.SSH_BRUTE_FORCE, newest(spark, sf))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan.split("PushedFilters")[1]
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1]


def test_one_scan_for_all_pattern_rules(spark, sf):
    from duskwatch.catalog.views import view

    patterns = [r for r in R.WEB_RULES if isinstance(r, R.PatternRule)]
    plan = R.run_rules(view(spark, sf, "web_logs"), patterns, NOW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
