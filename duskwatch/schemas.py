"""Table schemas (DDL strings) and the anomaly columns each log type stores."""

TABLES = {
    "ssh_logs": "id BIGINT, timestamp TIMESTAMP_NTZ, process_id INT, event_type STRING, user STRING, "
    "source_ip STRING, port INT, country_code STRING, forwarded_ports STRING",
    "web_logs": "id BIGINT, timestamp TIMESTAMP_NTZ, source_ip STRING, method STRING, path STRING, "
    "status_code INT, user_agent STRING",
    "firewall_logs": "id BIGINT, timestamp TIMESTAMP_NTZ, source_ip STRING, dest_ip STRING, "
    "protocol STRING, src_port INT, dest_port INT, action STRING",
    "mysql_logs": "id BIGINT, timestamp TIMESTAMP_NTZ, user STRING, source_ip STRING, "
    "event_type STRING, sql_statement STRING, duration DOUBLE",
    "hdfs_logs": "id BIGINT, timestamp TIMESTAMP_NTZ, pid INT, level STRING, component STRING, "
    "content STRING, Eventid STRING",
    "linux_logs": "id BIGINT, timestamp TIMESTAMP_NTZ, month STRING, date INT, time STRING, "
    "level STRING, component STRING, pid INT, content STRING",
    "logs": "log_id BIGINT, timestamp TIMESTAMP_NTZ, source_ip STRING, event_type STRING, "
    "message STRING, user STRING, detected_by STRING, created_at TIMESTAMP_NTZ",
    "rules": "rule_id BIGINT, name STRING, description STRING, sql_query STRING, action STRING, "
    "created_at TIMESTAMP_NTZ",
    "anomalies": "anomaly_id BIGINT, log_id BIGINT, rule_id BIGINT, detected_by STRING, "
    "ai_model_version STRING, score DOUBLE, anomaly_type STRING, description STRING, "
    "created_at TIMESTAMP_NTZ",
}

ANOMALY_TABLES = {
    "ssh": ["source_ip", "user", "anomaly_type", "details", "country_codes"],
    "web": ["source_ip", "anomaly_type", "details"],
    "firewall": ["source_ip", "anomaly_type", "details"],
    "mysql": ["user", "source_ip", "anomaly_type", "details"],
    "hdfs": ["pid", "anomaly_type", "details"],
    "linux": ["component", "pid", "detected", "anomaly_type", "details"],
}

REQUIRED = {
    "ssh_logs": ["timestamp", "event_type"],
    "web_logs": ["timestamp", "source_ip"],
    "firewall_logs": ["timestamp", "source_ip", "dest_ip"],
    "mysql_logs": ["timestamp", "event_type"],
    "hdfs_logs": ["timestamp"],
    "linux_logs": ["level", "component", "content"],
    "logs": ["source_ip", "event_type", "message"],
    "rules": ["name", "sql_query"],
    "anomalies": ["log_id", "detected_by"],
}


def columns(table: str) -> list[str]:
    return [part.split()[0] for part in TABLES[table].split(", ")]
