"""Questions answered together, against one template call per question."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from duskwatch.operators import questions as N
from duskwatch.operators.answers import ANSWER, answer_questions
from duskwatch.schemas import TABLES

NOW = datetime(2024, 5, 10, 12, 0, 0)
LOGS = "log_id BIGINT, timestamp TIMESTAMP_NTZ, source_ip STRING, event_type STRING, message STRING, user STRING, detected_by STRING"
TEXTS = [
    "最近3天admin用户的日志",
    "最近24小时的异常事件",
    "查看所有规则",
    "最近5天来自IP 10.0.0.2的前3条日志",
    "合并最近3天的异常和日志",
    "最近9天认证失败的次数",
    "昨天的日志",
    "从2024-05-02到2024-05-04的日志",
    "日志",
    "最近2天登录失败",
    "最近6天root的日志",
    "",
    None,
]


@pytest.fixture(scope="module")
def data(spark):
    users = ["admin", "root", None, "alice"]
    kinds = ["login", "failed_login", "access", None]
    texts = ["login failure for user=admin", "认证失败 from 10.0.0.2", "user_id=root denied", "ok", None, "deny 10_0_0_2"]
    rows = [
        (i, NOW - timedelta(hours=i), f"10.0.0.{i % 5}", kinds[i % 4], texts[i % 6], users[i % 4], "none") for i in range(260)
    ] + [(900, NOW + timedelta(hours=1), "10.0.0.2", "login", "later", "admin", "none"), (901, None, "10.0.0.2", "login", "x", "admin", "none")]
    logs = spark.createDataFrame(rows, LOGS)
    anomalies = spark.createDataFrame([(1000 + i, i, 1, "rules", None, 0.5, "xss", "", NOW) for i in range(0, 260, 3)], TABLES["anomalies"])
    rules = spark.createDataFrame([(i, f"r{i}", None, "q", "alert", NOW) for i in range(3)], TABLES["rules"])
    return logs, anomalies, rules


def _values(row, names):
    return tuple(str(row[n]) for n in names)


def test_answers_equal_one_call_per_question(spark, data):
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "question_id BIGINT, question STRING")
    together = answer_questions(asked, *data, NOW).collect()
    intents = {r["question_id"]: r.asDict() for r in N.read_intent(asked, NOW).collect()}
    kinds_seen = set()
    for number, intent in intents.items():
        kinds = list(intent["kinds"])[: 2 if intent["merge"] else 1]
        for kind in kinds:
            kinds_seen.add(kind)
            single = N.answer({**intent, "kinds": [kind], "merge": False}, *data, NOW)
            expected = sorted(_values(r, single.columns) for r in single.collect())
            mine = [r for r in together if r["question_id"] == number and r["kind"] == kind]
            assert sorted(_values(r, single.columns) for r in mine) == expected, (TEXTS[number], kind)
            unused = [c for c in ANSWER[2:] if c not in single.columns]
            assert all(r[c] is None for r in mine for c in unused)
        assert {r["kind"] for r in together if r["question_id"] == number} <= set(kinds)
    assert kinds_seen == {"logs", "anomalies", "rules", "login_failures"} and len(together) > 200


def test_only_names_with_signs_of_like_are_patterns(spark, data):
    """A plain name is looked for as it is; one with a wildcard finds what a single call finds."""
    asked = spark.createDataFrame([(0, "最近9天用户是adm_n的日志"), (1, "最近9天用户是ADMIN的日志")], "question_id BIGINT, question STRING")
    together = answer_questions(asked, *data, NOW)
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(_message" in plan
    intents = {r["question_id"]: r.asDict() for r in N.read_intent(asked, NOW).collect()}
    assert intents[0]["user"] == "adm_n" and intents[1]["user"].upper() == "ADMIN"
    rows = together.collect()
    for number, intent in intents.items():
        expected = {r["id"] for r in N.answer(intent, *data, NOW).collect()}
        assert expected and {r["id"] for r in rows if r["question_id"] == number} == expected


def test_no_questions_and_no_logs(spark, data):
    logs, anomalies, rules = data
    asked = spark.createDataFrame([(1, "日志"), (2, "规则")], "question_id BIGINT, question STRING")
    assert answer_questions(asked.limit(0), logs, anomalies, rules, NOW).count() == 0
    assert {r["question_id"] for r in answer_questions(asked, logs.limit(0), anomalies, rules, NOW).collect()} == {2}


def test_logs_meet_questions_on_days_only(spark, data):
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "question_id BIGINT, question STRING")
    plan = answer_questions(asked, *data, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and plan.count("_day") > 1
