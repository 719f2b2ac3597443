from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from duskwatch.sources import parsers as P
from duskwatch.sources import readers as D


def _one(spark, line, kind, **kw):
    df = spark.createDataFrame([(line,)], "line STRING")
    return P.parse(df, kind, **kw).first()


def test_ssh_samples(spark):
    row = _one(spark, "Nov 03 21:07:45 bastion7 sshd[881]: Failed password for invalid user gitlab from 203.0.113.9 port 40122 ssh2", "ssh", year=2025)
    assert (row["timestamp"], row["event_type"], row["user"], row["source_ip"], row["port"], row["process_id"]) == (
        datetime(2025, 11, 3, 21, 7, 45), "authentication_failure", "gitlab", "203.0.113.9", 40122, 881)
    row = _one(spark, "Feb 28 03:11:59 bastion7 sshd[902]: Accepted password for marta from 198.51.100.23 port 50514 ssh2", "ssh")
    assert (row["event_type"], row["user"]) == ("login_success", "marta")
    row = _one(spark, "Jul  4 00:30:08 bastion7 sshd[77]: Connection closed by 198.51.100.40 port 61003", "ssh", year=2023)
    assert (row["event_type"], row["source_ip"], row["timestamp"]) == ("connection_closed", "198.51.100.40", datetime(2023, 7, 4, 0, 30, 8))


def test_ssh_without_user_falls_through_and_ipv6_is_null(spark):
    assert _one(spark, "Aug 19 17:20:31 h sshd[1]: Invalid user  from 1.2.3.4", "ssh")["event_type"] == "other"
    row = _one(spark, "Aug 19 17:20:31 h sshd[1]: Failed password for root from ::1 port 22 ssh2", "ssh")
    assert row["event_type"] == "authentication_failure" and row["source_ip"] is None


def test_web_samples(spark):
    good = '203.0.113.77 - - [02/Sep/2024:05:06:07 +0200] "PUT /orders/17 HTTP/1.1" 201 88 "https://shop.example.org/cart" "curl/8.6.0"'
    row = _one(spark, good, "web")
    assert (row["method"], row["path"], row["status_code"], row["bytes_sent"]) == ("PUT", "/orders/17", 201, 88)
    assert row["timestamp"] == datetime(2024, 9, 2, 3, 6, 7)
    short = '203.0.113.78 - - [02/Sep/2024:05:06:08 +0200] "GET /find?id=7\' OR 2=2 HTTP/1.1" 404 512'
    assert _one(spark, short, "web")["_corrupt_record"] == short


def test_firewall_sample_with_mac(spark):
    line = "May 30 08:09:10 kernel: [UFW BLOCK] IN=ens3 OUT= MAC=aa:bb SRC=203.0.113.5 DST=10.9.8.7 LEN=60 PROTO=UDP SPT=5353 DPT=161 SYN"
    row = _one(spark, line, "firewall", year=2025)
    assert (row["action"], row["source_ip"], row["dest_ip"], row["protocol"], row["src_port"], row["dest_port"]) == ("DROP", "203.0.113.5", "10.9.8.7", "UDP", 5353, 161)
    assert row["timestamp"] == datetime(2025, 5, 30, 8, 9, 10)


def test_mysql_samples(spark):
    row = _one(spark, "2024-08-15T22:10:01.000250Z 41 [Note] Access denied for user 'backup'@'198.51.100.61' (using password: YES)", "mysql")
    assert (row["event_type"], row["user"], row["source_ip"]) == ("auth_failure", "backup", "198.51.100.61")
    assert row["timestamp"] == datetime(2024, 8, 15, 22, 10, 1, 250)
    row = _one(spark, "2024-08-15T22:10:02.500000Z 42 [Query] SELECT id FROM invoices WHERE total > 90", "mysql")
    assert row["sql_statement"] == "SELECT id FROM invoices WHERE total > 90"
    row = _one(spark, "2024-08-15T22:10:03.1Z 42 [Note] Query took 1.25 sec", "mysql")
    assert row["duration"] == 1.25 and row["sql_statement"] is None


def test_hdfs_sample_and_unknown_template(spark):
    row = _one(spark, "120731 010203 9 INFO dfs.DataNode$DataXceiver: Receiving block blk_-812 src: /10.40.3.2:41000 dest: /10.40.3.9:50010", "hdfs")
    assert (row["Eventid"], list(row["details"])) == ("E13", ["blk_-812", "/10.40.3.2:41000", "/10.40.3.9:50010"])
    assert row["timestamp"] == datetime(2012, 7, 31, 1, 2, 3)
    row = _one(spark, "120731 010203 9 INFO dfs.X: nothing known", "hdfs")
    assert row["Eventid"] is None and row["content"] == "nothing known" and row["_corrupt_record"] is None


def test_linux_sample(spark):
    line = "Oct 22 06:07:08 relay2 sshd(pam_unix)[5120]: authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=192.0.2.200 user=nagios"
    row = _one(spark, line, "linux", year=2005)
    assert (row["uid"], row["euid"], row["source_ip"], row["user"], row["ruser"], row["success"]) == ("0", "0", "192.0.2.200", "nagios", "", False)
    assert row["timestamp"] == datetime(2005, 10, 22, 6, 7, 8)


def test_modes(spark):
    lines = spark.createDataFrame([("bad",), ("120731 010203 9 INFO a: b",)], "line STRING")
    assert P.parse(lines, "hdfs", "DROPMALFORMED").count() == 1
    assert P.ingest_summary(P.parse(lines, "hdfs")).first().asDict() == {"lines": 2, "valid": 1, "malformed": 1}
    with pytest.raises(PySparkException, match="Invalid HDFS log format"):
        P.parse(lines, "hdfs", "FAILFAST").collect()
    with pytest.raises(ValueError, match="Unsupported log type"):
        P.parse(lines, "other")


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,ip,event,message\n2024-02-29,198.51.100.8,quota_exceeded,Mailbox full\n")
    row = D.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row["source_ip"], row["event_type"], row["message"]) == ("198.51.100.8", "quota_exceeded", "Mailbox full")
    (tmp_path / "a.txt").write_text("2024-02-29 23:59:01 [WARN] 198.51.100.8 - Disk almost full\nno header here\n")
    (row,) = D.read_txt(spark, str(tmp_path / "a.txt")).collect()
    assert (row["event_type"], row["source_ip"], row["message"]) == ("WARN", "198.51.100.8", "Disk almost full")
    (tmp_path / "a.jsonl").write_text('{"ip": "1.1.1.1", "event": "x"}\nnope\n{"source_ip": "2.2.2.2", "time": "t"}\n')
    rows = D.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r["source_ip"], r["event_type"], r["timestamp"], r["message"]) for r in rows] == [("1.1.1.1", "x", "", ""), ("2.2.2.2", "", "t", "")]


def test_sequence_files_keep_order_and_fall_back_to_latin1(spark, tmp_path):
    (tmp_path / "utf8.log").write_bytes("  eins \n\nzwei ü\n".encode())
    (tmp_path / "latin.log").write_bytes("drei \xfc\nvier\n".encode("latin-1"))
    rows = D.read_sequence(spark, str(tmp_path)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["idx"]):
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["line"])
    assert found == {"utf8.log": ["eins", "", "zwei ü"], "latin.log": ["drei ü", "vier"]}
    assert D.read_sequence(spark, str(tmp_path), keep_blank=False).count() == 4


def test_white_space_of_any_kind_is_stripped(spark):
    lines = spark.createDataFrame([(" x\t",), ("\t",), (" \u000b ",), ("",)], "line STRING")
    assert [r["line"] for r in D.non_blank(lines).collect()] == ["x"]


def test_labelled_fallback_and_missing_fields(spark):
    plain = spark.createDataFrame([("a line",), ("another",)], "line STRING")
    assert [tuple(r) for r in D.parse_labelled(plain).collect()] == [("a line", 0), ("another", 0)]
    broken = spark.createDataFrame([('{"text": "x"}',)], "line STRING")
    with pytest.raises(ValueError):
        D.parse_labelled(broken)


def test_timestamps_fill_both_ways(spark):
    rows = [(1, 0, "x"), (1, 1, "2024-01-01 10:00:00 a"), (1, 2, "y"), (1, 3, "2024-01-01 10:00:05 b"), (2, 0, "none"), (2, 1, "none")]
    found = D.detect_timestamps(spark.createDataFrame(rows, "seq_id INT, idx BIGINT, line STRING")).orderBy("seq_id", "idx").collect()
    ten, later = datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10, 0, 5)
    assert [r["ts"] for r in found] == [ten, ten, ten, later, None, None]
