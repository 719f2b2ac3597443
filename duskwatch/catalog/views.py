"""Log tables derived from the driver tables, as SQL both engines run.

Spark reads each view through ``view(spark, sf_dir, name)``; the DuckDB side
gets the same text as a common table expression through ``cte``. Only
arithmetic on ids and plain string functions are used, so both agree.
``{q}`` is the identifier quote, ``{ntz}`` the zone-free timestamp type and
``{div}`` whole-number division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_IP = (
    "concat('10.', CAST(user_id {div} 65536 % 256 AS STRING), '.', "
    "CAST(user_id {div} 256 % 256 AS STRING), '.', CAST(user_id % 256 AS STRING))"
)
_HDFS_MESSAGE = """CASE event_id % 14
    WHEN 0 THEN concat('Served block blk_', CAST(event_id AS STRING), ' to /', {ip})
    WHEN 1 THEN concat('Starting thread to transfer block blk_', CAST(event_id AS STRING), ' to ', {ip}, ':50010')
    WHEN 2 THEN concat({ip}, ':50010:Got exception while serving blk_', CAST(event_id AS STRING), ' to /', {ip}, ':')
    WHEN 3 THEN concat('BLOCK* ask ', {ip}, ':50010 to delete blk_', CAST(event_id AS STRING))
    WHEN 4 THEN concat('BLOCK* ask ', {ip}, ':50010 to replicate blk_', CAST(event_id AS STRING), ' to datanode(s) ', {ip}, ':50011')
    WHEN 5 THEN concat('BLOCK* NameSystem.addStoredBlock: blockMap updated: ', {ip}, ':50010 is added to blk_', CAST(event_id AS STRING), ' size 67108864')
    WHEN 6 THEN concat('BLOCK* NameSystem.allocateBlock: /user/job/part-', CAST(event_id AS STRING), ' blk_', CAST(event_id AS STRING))
    WHEN 7 THEN concat('BLOCK* NameSystem.delete: blk_', CAST(event_id AS STRING), ' is added to invalidSet of ', {ip}, ':50010')
    WHEN 8 THEN concat('Deleting block blk_', CAST(event_id AS STRING), ' file /mnt/dfs/blk_', CAST(event_id AS STRING))
    WHEN 9 THEN concat('PacketResponder 1 for block blk_', CAST(event_id AS STRING), ' terminating')
    WHEN 10 THEN concat('Received block blk_', CAST(event_id AS STRING), ' of size 67108864 from /', {ip})
    WHEN 11 THEN concat('Received block blk_', CAST(event_id AS STRING), ' src: /', {ip}, ':50010 dest: /', {ip}, ':50011 of size 9')
    WHEN 12 THEN concat('Receiving block blk_', CAST(event_id AS STRING), ' src: /', {ip}, ':50010 dest: /', {ip}, ':50011')
    ELSE concat('Verification succeeded for blk_', CAST(event_id AS STRING)) END""".replace("{ip}", _IP)

# name -> (base tables and views it reads, SQL)
VIEWS: dict[str, tuple[list[str], str]] = {
    "ssh_logs": (["events"], f"""
SELECT event_id AS id, ts AS timestamp, CAST(event_id % 32768 AS INT) AS process_id,
  CASE event_type WHEN 'error' THEN 'authentication_failure' WHEN 'signup' THEN 'invalid_user'
    WHEN 'purchase' THEN 'login_success' WHEN 'view' THEN 'connection_closed'
    ELSE 'reverse_dns_failure' END AS event_type,
  concat('u', CAST(event_id % 7 AS STRING)) AS {{q}}user{{q}}, {_IP} AS source_ip,
  CAST(1024 + event_id % 50000 AS INT) AS port
FROM events"""),
    "ssh_attempts": (["events"], f"""
SELECT event_id AS id, ts AS timestamp, CASE event_type WHEN 'error' THEN 'connection_attempt' WHEN 'purchase' THEN 'invalid_port'
    WHEN 'view' THEN 'connection_attempt' ELSE 'connection_closed' END AS event_type,
  {_IP} AS source_ip, CAST(CASE WHEN event_id % 3 = 0 THEN 22 ELSE 1024 + event_id % 20 END AS INT) AS port
FROM events"""),
    "web_logs": (["events"], f"""
SELECT event_id AS id, ts AS timestamp, {_IP} AS source_ip,
  CASE WHEN event_id % 20 = 0 THEN 'PUT' WHEN event_id % 20 = 1 THEN 'DELETE'
    WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
  concat('/item/', CAST(event_id % 13 AS STRING), CASE event_id % 50
    WHEN 0 THEN '?q=1 UNION SELECT 2' WHEN 1 THEN '?q=union all select 2' WHEN 2 THEN '?id=1=1'
    WHEN 3 THEN '?x=DROP TABLE t' WHEN 4 THEN '?c=<script>x</script>' WHEN 5 THEN '?c=ALERT(1)'
    WHEN 6 THEN '/../secret' WHEN 7 THEN '/etc/passwd' WHEN 8 THEN '/win.ini'
    WHEN 9 THEN '/.git/config' WHEN 10 THEN '/wp-admin/' WHEN 11 THEN '/PhpMyAdmin/' ELSE '' END) AS path,
  CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 401
    WHEN event_id % 3 = 1 THEN 403 ELSE 404 END AS INT) AS status_code,
  CASE event_id % 40 WHEN 0 THEN 'sqlmap/1.5' WHEN 1 THEN 'Nmap Scripting Engine'
    WHEN 2 THEN 'HYDRA' ELSE 'Mozilla/5.0 (X11; Linux x86_64)' END AS user_agent
FROM events"""),
    "firewall_logs": (["events"], f"""
SELECT event_id AS id, ts AS timestamp,
  CASE WHEN event_id % 3 = 0 THEN concat('192.168.', CAST(user_id {{div}} 256 % 256 AS STRING), '.', CAST(user_id % 256 AS STRING))
    ELSE {_IP} END AS source_ip,
  CASE WHEN event_id % 4 < 2 THEN concat('192.168.1.', CAST(event_id % 200 AS STRING))
    ELSE concat('8.8.', CAST(event_id % 7 AS STRING), '.', CAST(event_id % 200 AS STRING)) END AS dest_ip,
  CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
  CAST(1024 + event_id % 40000 AS INT) AS src_port,
  CAST(CASE WHEN event_id % 10 = 0 THEN 80 WHEN event_id % 33 = 0 THEN 445
    ELSE event_id % 1000 END AS INT) AS dest_port,
  CASE WHEN event_type = 'error' THEN 'DROP' ELSE 'ACCEPT' END AS action
FROM events"""),
    "mysql_logs": (["events"], f"""
SELECT event_id AS id, ts AS timestamp, concat('u', CAST(event_id % 7 AS STRING)) AS {{q}}user{{q}}, {_IP} AS source_ip,
  CASE WHEN event_type = 'error' THEN 'auth_failure' WHEN event_id % 6 = 0 THEN 'high_risk_operation'
    ELSE 'query' END AS event_type,
  CASE event_id % 6 WHEN 0 THEN 'DROP TABLE t1' WHEN 1 THEN 'grant all on db.* to x'
    WHEN 2 THEN 'REVOKE INSERT ON db.t FROM x' WHEN 3 THEN 'SELECT * FROM customers'
    WHEN 4 THEN 'select * from orders limit 5' ELSE 'UPDATE t SET a = 1' END AS sql_statement,
  value AS duration
FROM events"""),
    "hdfs_logs": (["events"], f"""
SELECT event_id AS id, ts AS timestamp, CAST(user_id AS INT) AS pid,
  CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS level,
  CASE event_id % 5 WHEN 0 THEN 'dfs.DataNode$DataXceiver' WHEN 1 THEN 'dfs.FSNamesystem'
    WHEN 2 THEN 'dfs.DataNode$PacketResponder' WHEN 3 THEN 'dfs.DataBlockScanner'
    ELSE 'dfs.FSDataset' END AS component,
  {_HDFS_MESSAGE} AS content,
  concat('E', CAST(1 + event_id % 14 AS STRING)) AS Eventid
FROM events"""),
    "logs": (["events"], f"""
SELECT event_id AS log_id, ts AS timestamp, {_IP} AS source_ip,
  CASE event_type WHEN 'error' THEN 'failed_login' WHEN 'signup' THEN 'login'
    WHEN 'purchase' THEN 'file_access' WHEN 'view' THEN 'access' ELSE 'logout' END AS event_type,
  CASE event_type
    WHEN 'error' THEN concat('Login failed for user=', CASE event_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'root' WHEN 2 THEN 'guest' WHEN 3 THEN 'alice' WHEN 4 THEN 'bob' ELSE 'carol' END, ' from ', {_IP})
    WHEN 'signup' THEN concat('login success user: ', CASE event_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'root' WHEN 2 THEN 'guest' WHEN 3 THEN 'alice' WHEN 4 THEN 'bob' ELSE 'carol' END, ' src=', {_IP})
    WHEN 'purchase' THEN concat('2024-01-05 10:00:00.123 INFO FileServer: read /data/part-', CAST(event_id AS STRING), ' from ', {_IP})
    WHEN 'view' THEN concat('access=ok path=/item/', CAST(event_id % 13 AS STRING), ' client=', {_IP})
    ELSE concat('session closed, ', CASE event_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'root' WHEN 2 THEN 'guest' WHEN 3 THEN 'alice' WHEN 4 THEN 'bob' ELSE 'carol' END, '_user left; invalid token') END AS message,
  CASE event_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'root' WHEN 2 THEN 'guest' WHEN 3 THEN 'alice' WHEN 4 THEN 'bob' ELSE 'carol' END AS {{q}}user{{q}},
  CASE WHEN event_type = 'error' THEN 'rules' WHEN value > 50 THEN 'AI' ELSE 'none' END AS detected_by, ts AS created_at
FROM events"""),
    "rules": (["supplier"], """
SELECT CAST(s_suppkey AS BIGINT) AS rule_id, concat('rule_', CAST(s_suppkey AS STRING)) AS name,
  concat('watch ', s_name) AS description, 'SELECT * FROM logs' AS sql_query,
  CASE s_suppkey % 3 WHEN 0 THEN 'alert' WHEN 1 THEN 'block' ELSE 'log' END AS action,
  CAST('2024-01-01 00:00:00' AS {ntz}) + CAST(s_suppkey AS INT) * INTERVAL '1' MINUTE AS created_at
FROM supplier"""),
    "auth_logs": (["logs"], """
SELECT log_id, timestamp, source_ip, event_type, {q}user{q}, detected_by,
  CASE WHEN event_type = 'login' AND log_id % 3 = 0 THEN concat('login failure for user=', {q}user{q}) ELSE message END AS message
FROM logs"""),
    "asked": (["nation"], """
SELECT CAST(n_nationkey AS BIGINT) AS question_id, CAST(n_nationkey % 9 + 1 AS BIGINT) AS days, CAST(n_nationkey % 15 + 1 AS BIGINT) AS most,
  concat('10.0.0.', CAST(n_nationkey % 20 AS STRING)) AS ip, CAST(n_nationkey % 5 AS INT) AS form,
  CASE n_nationkey % 5 WHEN 0 THEN concat('最近', CAST(n_nationkey % 9 + 1 AS STRING), '天登录失败的次数')
    WHEN 1 THEN concat('最近', CAST(n_nationkey % 9 + 1 AS STRING), '天的异常')
    WHEN 2 THEN '查看规则'
    WHEN 3 THEN concat('最近', CAST(n_nationkey % 9 + 1 AS STRING), '天来自IP 10.0.0.', CAST(n_nationkey % 20 AS STRING), ' 的前', CAST(n_nationkey % 15 + 1 AS STRING), '条日志')
    ELSE concat('合并最近', CAST(n_nationkey % 9 + 1 AS STRING), '天的异常和日志') END AS question
FROM nation"""),
    "stored_rules": (["supplier"], """
SELECT CAST(s_suppkey AS BIGINT) AS rule_id, concat('rule ', CAST(s_suppkey AS STRING)) AS name, concat('watch ', s_name) AS description,
  CASE s_suppkey % 7
    WHEN 0 THEN concat('SELECT log_id FROM logs WHERE event_type = ''failed_login'' AND log_id % 50 = ', CAST(s_suppkey % 50 AS STRING))
    WHEN 1 THEN 'select * from logs where user = ''root'' and hour(timestamp) < 6'
    WHEN 2 THEN concat('SELECT log_id FROM anomalies WHERE score > 0.', CAST(10 + s_suppkey % 80 AS STRING))
    WHEN 3 THEN 'SELECT max(log_id) AS log_id FROM logs GROUP BY source_ip HAVING count(*) > 3'
    WHEN 4 THEN 'SELECT log_id FROM logs WHERE no_such_column = 1'
    WHEN 5 THEN 'SELECT log_id FROM'
    ELSE 'SELECT log_id FROM logs WHERE detected_by = ''AI'' OR message IS NULL' END AS sql_query
FROM supplier WHERE s_suppkey <= 70"""),
    "anomalies": (["events"], """
SELECT event_id AS anomaly_id, event_id AS log_id, event_id % 120 AS rule_id,
  CASE event_id % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'AI' ELSE 'both' END AS detected_by,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'v1' END AS ai_model_version,
  CAST((event_id * 37) % 1000 AS DOUBLE) / 1000 AS score,
  CASE event_id % 4 WHEN 0 THEN 'brute_force' WHEN 1 THEN 'xss' WHEN 2 THEN 'scanner' ELSE 'ddos' END AS anomaly_type,
  concat('event ', CAST(event_id AS STRING)) AS description, ts AS created_at
FROM events WHERE event_type = 'error'"""),
    "geo_ranges": (["nation"], """
SELECT CAST(167772160 + n_nationkey * 5 AS BIGINT) AS ip_start,
  CAST(167772164 + n_nationkey * 5 AS BIGINT) AS ip_end, n_name AS country
FROM nation"""),
    "blacklist": (["supplier"], """
SELECT concat('10.0.0.', CAST(s_suppkey % 256 AS STRING)) AS source_ip FROM supplier"""),
    "score_series": (["events"], """
SELECT event_id AS idx, ts, CASE event_id % 5 WHEN 0 THEN 'knn' WHEN 1 THEN 'cluster' WHEN 2 THEN 'lof'
    WHEN 3 THEN 'iforest' ELSE 'reconstruction' END AS method,
  (value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) AS score
FROM events"""),
    "scored_labels": (["documents", "labels"], """
SELECT d.doc_id, CASE d.doc_id % 3 WHEN 0 THEN 'knn' WHEN 1 THEN 'lof' ELSE 'ensemble' END AS method,
  CAST(d.n_chars - (SELECT min(n_chars) FROM documents) AS DOUBLE)
    / ((SELECT max(n_chars) FROM documents) - (SELECT min(n_chars) FROM documents)) AS score, l.toxic AS label, d.text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "sequences": (["events"], """
SELECT user_id AS seq_id, ts, event_id, concat(event_type, ' by ', CAST(user_id AS STRING), ' value ', CAST(event_id % 10 AS STRING)) AS line
FROM events"""),
    "questions": (["events"], f"""
SELECT event_id AS question_id, CASE event_id % 12
    WHEN 0 THEN concat('最近', CAST(event_id % 48 + 1 AS STRING), '小时的登录失败')
    WHEN 1 THEN '今天的异常事件'
    WHEN 2 THEN '用户admin的登录记录'
    WHEN 3 THEN concat('来自IP ', {_IP}, '的请求')
    WHEN 4 THEN concat('过去', CAST(event_id % 9 + 1 AS STRING), '天用户是root的访问')
    WHEN 5 THEN '从2024-01-05到2024-01-09 12:30的上传成功记录'
    WHEN 6 THEN concat('前', CAST(event_id % 20 + 1 AS STRING), '条删除日志')
    WHEN 7 THEN '列出规则'
    WHEN 8 THEN concat(CAST(event_id % 5 + 1 AS STRING), '天前的下载被拒绝')
    WHEN 9 THEN concat('IP是', {_IP}, '，上周所有可疑攻击')
    WHEN 10 THEN '合并显示登录失败和异常'
    ELSE concat('log record of admin sign-in failed ', CAST(event_id AS STRING)) END AS question
FROM events"""),
    "raw_ssh": (["events"], f"""
SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'garbage line' ELSE concat('{{mon}} ', CAST(1 + event_id % 28 AS STRING),
    ' 09:32:', CASE WHEN event_id % 60 < 10 THEN '0' ELSE '' END, CAST(event_id % 60 AS STRING), ' server sshd[', CAST(event_id % 32768 AS STRING), ']: ',
    CASE event_id % 7
      WHEN 0 THEN concat('Failed password for invalid user u', CAST(event_id % 9 AS STRING), ' from ', {_IP}, ' port ', CAST(1024 + event_id % 50000 AS STRING), ' ssh2')
      WHEN 1 THEN concat('Failed password for u', CAST(event_id % 9 AS STRING), ' from ', {_IP}, ' port ', CAST(1024 + event_id % 50000 AS STRING), ' ssh2')
      WHEN 2 THEN concat('Invalid user u', CAST(event_id % 9 AS STRING), ' from ', {_IP})
      WHEN 3 THEN concat('Connection closed by ', {_IP}, ' port 49812')
      WHEN 4 THEN concat('reverse mapping checking getaddrinfo for host [', {_IP}, '] failed - POSSIBLE BREAK-IN ATTEMPT!')
      WHEN 5 THEN concat('Accepted password for u', CAST(event_id % 9 AS STRING), ' from ', {_IP}, ' port ', CAST(1024 + event_id % 50000 AS STRING), ' ssh2')
      ELSE CASE WHEN event_id % 2 = 0 THEN concat('forwarding port ', CAST(event_id % 1000 AS STRING), '->db.local:3306') ELSE 'Server listening on 0.0.0.0' END END) END AS line
FROM events""".replace("{mon}", "Dec")),
    "raw_web": (["events", "web_logs"], """
SELECT id AS event_id, CASE WHEN id % 101 = 0 THEN 'garbage line' ELSE concat(source_ip, ' - - [', CASE WHEN 1 + id % 28 < 10 THEN '0' ELSE '' END,
    CAST(1 + id % 28 AS STRING), '/Apr/2023:14:15:16 +0000] "', method, ' ', path, ' HTTP/1.1" ', CAST(status_code AS STRING), ' ',
    CAST(id % 5000 AS STRING), ' "https://example.com" "', user_agent, '"') END AS line
FROM web_logs"""),
    "raw_firewall": (["events", "firewall_logs"], """
SELECT id AS event_id, CASE WHEN id % 101 = 0 THEN 'garbage line' ELSE concat('Mar ', CAST(10 + id % 18 AS STRING), ' 12:34:56 kernel: [UFW ',
    CASE WHEN action = 'DROP' THEN 'BLOCK' ELSE 'ALLOW' END, '] IN=eth0 OUT= ', CASE WHEN id % 2 = 0 THEN 'MAC=00:11:22 ' ELSE '' END,
    'SRC=', source_ip, ' DST=', dest_ip, ' LEN=40 PROTO=', protocol, ' SPT=', CAST(src_port AS STRING), ' DPT=', CAST(dest_port AS STRING), ' SYN') END AS line
FROM firewall_logs"""),
    "raw_mysql": (["events", "mysql_logs"], """
SELECT id AS event_id, CASE WHEN id % 101 = 0 THEN 'garbage line' ELSE concat('2025-03-24T12:34:56.123456Z ', CAST(id % 9 AS STRING), ' ', CASE id % 5
    WHEN 0 THEN concat('[Note] Access denied for user ''', {q}user{q}, '''@''', source_ip, ''' (using password: YES)')
    WHEN 1 THEN concat('[Query] ', sql_statement)
    WHEN 2 THEN concat('[Note] Query: ', sql_statement)
    WHEN 3 THEN concat('[Warning] Query took ', CAST(id % 90 AS STRING), '.5 sec')
    ELSE '[Note] ready for connections' END) END AS line
FROM mysql_logs"""),
    "raw_hdfs": (["events", "hdfs_logs"], """
SELECT id AS event_id, CASE WHEN id % 101 = 0 THEN 'garbage line' ELSE concat('0811', CAST(10 + id % 18 AS STRING), ' 2049', CAST(10 + id % 50 AS STRING), ' ',
    CAST(pid AS STRING), ' ', level, ' ', component, ': ', content) END AS line
FROM hdfs_logs"""),
    "raw_linux": (["events"], f"""
SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'garbage line' ELSE concat('Jun ', CAST(10 + event_id % 18 AS STRING), ' 15:16:01 combo sshd(pam_unix)',
    CASE WHEN event_id % 2 = 0 THEN '' ELSE ' ' END, '[', CAST(event_id % 30000 AS STRING), ']: ', CASE event_id % 5
    WHEN 0 THEN concat('authentication failure; logname= uid=0 euid=0 tty=NODEVssh ruser= rhost=', {_IP}, ' user=root')
    WHEN 1 THEN 'check pass; user unknown'
    WHEN 2 THEN 'check pass; ok'
    WHEN 3 THEN concat('Connection closed by ', {_IP})
    ELSE 'session opened for user root' END) END AS line
FROM events"""),
    "raw_txt": (["logs", "events"], """
SELECT log_id AS event_id, CASE WHEN log_id % 101 = 0 THEN 'Invalid log format' ELSE concat('2023-01-01 12:00:', CAST(10 + log_id % 50 AS STRING), ' [',
    CASE WHEN event_type = 'failed_login' THEN 'WARN' ELSE 'INFO' END, '] ', source_ip, ' - ', message) END AS line
FROM logs"""),
    "raw_csv": (["logs", "events"], """
SELECT log_id AS event_id, concat('2023-01-01,', CASE WHEN log_id % 3 = 0 THEN '' ELSE source_ip END, ',', source_ip, ',',
    CASE WHEN log_id % 2 = 0 THEN event_type ELSE '' END, ',"', message, '"') AS line
FROM logs"""),
    "raw_jsonl": (["logs", "events"], """
SELECT log_id AS event_id, CASE WHEN log_id % 101 = 0 THEN '{{not json'
    WHEN log_id % 2 = 0 THEN concat('{{"time": "2023-01-01 00:00:00", "ip": "', source_ip, '", "event": "', event_type, '", "message": "', message, '"}}')
    ELSE concat('{{"timestamp": "2023-01-02 00:00:00", "ip": "", "source_ip": "', source_ip, '", "event_type": "', event_type, '"}}') END AS line
FROM logs"""),
    "raw_labelled": (["events"], """
SELECT event_id, CASE WHEN event_id % 101 = 0 THEN '{{not json'
    ELSE concat('{{"text": "', event_type, ' event ', CAST(event_id AS STRING), '", "label": ', CASE WHEN event_type = 'error' THEN '1' ELSE '0' END, '}}') END AS line
FROM events"""),
}

BASE = {"events", "supplier", "nation", "documents", "labels", "embeddings", "conversations", "orders", "lineitem", "pages", "customer", "part", "benchmark", "region"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a lazy DataFrame over the tables in ``sf_dir``."""
    needs, sql = VIEWS[name]
    text = sql.format(q="`", ntz="TIMESTAMP_NTZ", div="DIV", mon="Dec")
    inputs = {
        n: table(spark, sf_dir, n) if n in BASE else view(spark, sf_dir, n) for n in needs
    }
    text = text.replace("{", "{{").replace("}", "}}")  # JSON braces are not placeholders
    for n in needs:
        text = _point(text, n)
    return spark.sql(text, **{n: df for n, df in inputs.items() if "{" + n + "}" in text})


def _point(text: str, name: str) -> str:
    """Turn ``FROM name`` / ``JOIN name`` into the ``{name}`` placeholder."""
    out = text
    for word in ("FROM", "JOIN"):
        for end in (" ", "\n", ",", ")"):
            out = out.replace(f"{word} {name}{end}", f"{word} {{{name}}}{end}")
        if out.endswith(f"{word} {name}"):
            out = out[: -len(name)] + "{" + name + "}"
    return out


def cte(*names: str) -> str:
    """``WITH`` clause defining the views (and the views they read) for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            if needed not in BASE:
                add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    text = [
        f"{n} AS ({VIEWS[n][1].format(q=chr(34), ntz='TIMESTAMP', div='//', mon='Dec')})" for n in order
    ]
    return "WITH " + ", ".join(text) + " "
