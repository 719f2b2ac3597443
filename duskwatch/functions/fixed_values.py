"""Patterns, word lists, limits and texts that results depend on.

Everything here is data. Changing an entry changes what the operators return.
"""

# --- rule patterns (SQL wildcards, matched without regard to case) -----------
SQL_INJECTION_PATHS = ["%UNION%SELECT%", "%1=1%", "%DROP%TABLE%"]
XSS_PATHS = ["%<script>%", "%alert(%"]
TRAVERSAL_PATHS = ["%/../%", "%/etc/passwd%", "%/win.ini%"]
SENSITIVE_PATHS = ["%/.git/config%", "%/wp-admin/%", "%/phpmyadmin/%"]
SUSPICIOUS_AGENTS = ["%sqlmap%", "%nmap%", "%hydra%"]
USUAL_HTTP_METHODS = ["GET", "POST", "HEAD"]
UDP_PORTS_OF_CONCERN = [137, 138, 139, 445]
INTERNAL_PREFIX = "192.168."
DROP_TABLE_STATEMENTS = ["%DROP%TABLE%"]
PRIVILEGE_STATEMENTS = ["%GRANT%ALL%", "%REVOKE%"]
EXPORT_STATEMENT = "SELECT%*%FROM%"
LIMITED_STATEMENT = "%LIMIT%"

# --- reason texts (printf form) ----------------------------------------------
REASON_SSH_BRUTE_FORCE = "SSH暴力破解检测：%s次失败尝试"
REASON_USER_ENUMERATION = "可疑用户枚举：尝试了%s个不同用户"
REASON_REVERSE_DNS = "反向DNS解析失败告警: %s 触发%s次"
REASON_HIGH_FREQUENCY = "高频连接: %s %s次/%s分钟"
REASON_GEO_ANOMALY = "用户 %s %s小时内从 %s 个国家登录"
REASON_GLOBAL_DDOS = "全局DDoS攻击迹象：1分钟内无效登录尝试%s次（超过60次阈值）"
REASON_SSH_PORT_SCANNING = "端口扫描行为检测：尝试连接%s个不同端口"
REASON_SSH_PROTOCOL = "非常用SSH端口访问：端口%s尝试%s次"
REASON_SQL_INJECTION = "疑似SQL注入攻击：%s"
REASON_XSS = "疑似XSS攻击：%s"
REASON_WEB_BRUTE_FORCE = "Web暴力破解检测：%s次失败尝试"
REASON_SCANNER = "疑似扫描行为：%s次404错误"
REASON_TRAVERSAL = "疑似目录遍历攻击：%s"
REASON_SENSITIVE = "疑似敏感文件访问：%s"
REASON_AGENT = "可疑工具标识：%s"
REASON_HIGH_FREQUENCY_REQUESTS = "高频请求：%s (%s次/分钟)"
REASON_HTTP_METHOD = "非常用HTTP方法：%s %s"
REASON_FIREWALL_PORT_SCAN = "疑似端口扫描：%s个端口被探测"
REASON_FIREWALL_DDOS = "疑似DDoS攻击：%s次SYN请求"
REASON_BLACKLIST = "命中IP黑名单"
REASON_PROTOCOL = "非常用协议：%s:%s"
REASON_OUTBOUND = "内网IP异常外联至：%s"
REASON_MYSQL_BRUTE_FORCE = "MySQL暴力破解：%s次失败尝试"
REASON_HIGH_RISK_SQL = "高危操作：%s"
REASON_PRIVILEGE = "权限变更操作：%s"
REASON_EXPORT = "疑似数据导出：%s"
REASON_OFF_HOURS = "非工作时间操作：%s"
REASON_SERVICE_BRUTE_FORCE = "组件级暴力操作：组件%s异常%s次"
REASON_DELETIONS = "异常删除行为：进程%s5分钟内删除%s次"
REASON_TRANSMISSION = "传输失败：5分钟内传输失败%s次"
REASON_PARSED_REVERSE_DNS = "反向DNS解析失败，存在潜在攻击"

# --- line formats (Java regular expressions) ---------------------------------
SSH_HEADER = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}).*sshd\[(\d+)\]:\s+(.*)"
WEB_COMBINED = (
    r'^(\S+) \S+ \S+ \[(.*?)\] "(\S+) (.*?) HTTP/\d\.\d" (\d{3}) (\d+) "(.*?)" "(.*?)"'
)
FIREWALL_LINE = (
    r"(\w{3} +\d{1,2} \d{2}:\d{2}:\d{2}) .*?\[UFW (\w+)\] IN=(\S+)? OUT=(\S+)? "
    r"(?:MAC=\S* )?SRC=(\S+) DST=(\S+) .*?PROTO=(\S+) SPT=(\d+) DPT=(\d+)"
)
MYSQL_HEADER = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+\d+\s+\[(\w+)\]\s+(.*)"
HDFS_HEADER = r"^(\d{2})(\d{2})(\d{2})\s(\d{6})\s(\d+)\s(\w+)\s(.*?):\s(.*)$"
LINUX_HEADER = (
    r"^(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\w+)\s+(sshd\(\w+\))\s*\[(\d+)\]:\s+(.*)"
)
TXT_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+\.\d+\.\d+\.\d+) - (.+)"
IPV4 = r"\d+\.\d+\.\d+\.\d+"
IPV4_SHAPE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
HDFS_TEMPLATES = {
    "E1": r"Served block (\S+) to (\S+)",
    "E2": r"Starting thread to transfer block (\S+) to (\S+)",
    "E3": r"(\S+):Got exception while serving (\S+) to (\S+):",
    "E4": r"BLOCK\* ask (\S+) to delete (\S+)",
    "E5": r"BLOCK\* ask (\S+) to replicate (\S+) to datanode\(s\) (\S+)",
    "E6": r"BLOCK\* NameSystem\.addStoredBlock: blockMap updated: (\S+) is added to (\S+) size (\S+)",
    "E7": r"BLOCK\* NameSystem\.allocateBlock: (\S+) (\S+)",
    "E8": r"BLOCK\* NameSystem\.delete: (\S+) is added to invalidSet of (\S+)",
    "E9": r"Deleting block (\S+) file (\S+)",
    "E10": r"PacketResponder (\S+) for block (\S+) terminating",
    "E11": r"Received block (\S+) of size (\S+) from (\S+)",
    "E12": r"Received block (\S+) src: (\S+) dest: (\S+) of size (\S+)",
    "E13": r"Receiving block (\S+) src: (\S+) dest: (\S+)",
    "E14": r"Verification succeeded for (\S+)",
}
LINUX_KEYS = ["logname", "uid", "euid", "tty", "ruser", "rhost", "user"]
LINE_TIMESTAMPS = [
    ("iso", r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)"),
    ("standard", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)"),
    ("bracketed", r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]"),
    ("slashes", r"(\d{4}/\d{2}/\d{2})"),
    ("american", r"(\w{3} \d{2}, \d{4} \d{2}:\d{2}:\d{2} (?:AM|PM))"),
]
INVALID_LINE_MESSAGES = {
    "ssh": "Invalid SSH log format",
    "web": "Invalid web log format",
    "firewall": "Invalid iptables log format",
    "mysql": "Invalid MYSQL log format",
    "hdfs": "Invalid HDFS log format",
    "linux": "Invalid LINUX log format",
}

# --- text cleaning ------------------------------------------------------------
CLEANING_STEPS = [
    (r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}.\d{3}", ""),
    (r"\b(INFO|DEBUG|ERROR|WARNING|WARN|TRACE)\b", ""),
    (r"\s+", " "),
]
CLEANING_LAST = r"[^a-zA-Z0-9\s]"
WINDOW_SEPARATOR = " [SEP] "

# --- allowed values -----------------------------------------------------------
LOG_DETECTED_BY = ["none", "rules", "AI", "both"]
ANOMALY_DETECTED_BY = ["rules", "AI", "both"]
RULE_ACTIONS = ["alert", "block", "log"]

# --- question vocabulary ------------------------------------------------------
TIME_UNITS = {"小时": "hour", "天": "day", "周": "week", "月": "month"}
EVENT_WORDS = {
    "登录": "login",
    "登陆": "login",
    "注销": "logout",
    "访问": "access",
    "读取": "read",
    "写入": "write",
    "删除": "delete",
    "修改": "modify",
    "上传": "upload",
    "下载": "download",
    "执行": "execute",
}
STATUS_WORDS = {
    "成功": "success",
    "失败": "failure",
    "拒绝": "denied",
    "通过": "success",
    "阻止": "blocked",
}
ANOMALY_WORDS = ["异常", "可疑", "攻击", "威胁", "恶意", "风险"]
ANOMALY_TEMPLATE_WORDS = ["异常", "可疑", "攻击"]
LOGIN_FAILURE_PHRASES = ["登录失败", "失败登录"]
RULE_WORD = "规则"
LOG_WORDS = ["日志", "记录", "log", "record", "列出"]
MERGE_WORDS = ["合并", "综合", "全部", "所有", "all", "combine", "merge", "union"]
FAILURE_MESSAGES = ["%fail%", "%失败%", "%拒绝%", "%deny%", "%invalid%"]
DATE_FORMATS = [
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
    "yyyy/M/d H:m:s",
    "yyyy/M/d H:m",
    "yyyy/M/d",
    "yyyy年M月d日 H:m:s",
    "yyyy年M月d日 H:m",
    "yyyy年M月d日",
]
YEARLESS_DATE_FORMAT = "M月d日 H:m"
USER_SPELLINGS = [
    "user={v}", "username={v}", "{v}_user", "user:{v}", "用户={v}", "user_name={v}",
    "userid={v}", "user_id={v}", "usr={v}", "login={v}", "account={v}", "id={v}",
    "auth={v}", "authentication={v}", "user '{v}'", 'user "{v}"', "user\t{v}", "user\n{v}",
    "user = {v}", "user= {v}", "user ={v}", "user: {v}",
]
IP_SPELLINGS = [
    "IP={v}", "source={v}", "from {v}", "src={v}", "source_ip={v}", "ip_addr={v}",
    "addr={v}", "address={v}", "来源={v}", "源IP={v}", "destination={v}", "dst={v}",
    "ip:{v}", "host={v}", "client={v}", "source_address={v}", "client_ip={v}",
    "IP : {v}", "IP: {v}", "IP = {v}", "IP= {v}", "IP ={v}",
]
EVENT_SPELLINGS = [
    "event={v}", "action={v}", "operation={v}", "type={v}", "event_type={v}", "activity={v}",
    "事件={v}", "操作={v}", "行为={v}", "{v} event", "{v} operation", "event:{v}",
    "action:{v}", "type:{v}",
]
LOGIN_SYNONYMS = [
    "login", "logged in", "sign in", "signin", "log in", "logging in", "登录", "登陆", "认证", "鉴权",
]
FAILURE_SYNONYMS = [
    "failed", "failure", "unsuccessful", "denied", "rejected", "invalid", "wrong", "incorrect",
    "error", "失败", "拒绝", "错误", "无效",
]
FAILED_LOGIN_MESSAGES = [
    "login failed", "failed login", "login failure", "authentication failed", "auth failure",
    "登录失败", "认证失败",
]
FAILURE_TERMS = ["failed", "failure", "unsuccessful", "error"]
USER_TERMS = ["admin", "administrator", "root", "system", "guest"]
COMMON_USERS = ["admin", "root", "administrator", "system", "guest", "user"]
EVENT_GROUPS = {
    "login": ["登录", "登陆", "signin", "sign-in", "log in"],
    "logout": ["登出", "注销", "signout", "sign-out", "log out"],
    "access": ["访问", "access", "visit"],
    "file_access": ["文件访问", "file access", "读取文件", "写入文件"],
    "failed_login": ["登录失败", "login failed", "认证失败"],
    "authentication": ["认证", "鉴权", "auth"],
}
STATUS_GROUPS = {
    "failed": ["失败", "错误", "拒绝", "无效"],
    "success": ["成功", "通过", "允许"],
    "denied": ["拒绝", "禁止", "阻止"],
    "error": ["错误", "异常", "失败"],
}

# --- scoring ------------------------------------------------------------------
METHODS = ["knn", "cluster", "lof", "iforest", "reconstruction"]
KNN_NEIGHBOURS = 5
LOF_NEIGHBOURS = 20
LOF_OFFSET = 1.5
CLUSTERS = 10
BANK_LIMIT = 10_000
BANK_MINIMUM = 10
QUEUE_LIMIT = 4_096
TREES = 100
TREE_SAMPLE = 256
VARIANCE_BANDS = [
    (0.8, "极强的区分力"),
    (0.6, "很好的区分力"),
    (0.4, "中等区分力"),
    (0.2, "较弱区分力"),
]
VARIANCE_LOWEST = "很弱区分力"

# --- assessment texts ---------------------------------------------------------
GRADES = [(80, "优秀"), (60, "良好"), (40, "一般")]
GRADE_LOWEST = "不佳"
GRADE_SUMMARIES = {
    "优秀": "模型表现优秀，能够有效区分正常和异常样本",
    "良好": "模型表现良好，对大部分异常有一定的检测能力",
    "一般": "模型表现一般，检测效果有限，可能需要调整",
    "不佳": "模型表现不佳，检测效果较差，建议重新调整",
}
FACTOR_SKEW = [
    "分数分布呈现明显的右偏趋势，有利于区分异常",
    "分数分布呈现右偏趋势，对异常检测有一定帮助",
    "分数分布接近对称，可能难以区分正常和异常样本",
]
FACTOR_ENTROPY = [
    "分数熵较低，表明分数分布较为集中，有明确的正常模式",
    "分数熵适中，分数分布有一定的模式",
    "分数熵较高，分数分布较为混乱，难以区分正常和异常",
]
FACTOR_RATIO = [
    "异常比例为%s，在合理范围内",
    "异常比例为%s，较低，可能需要降低阈值",
    "异常比例为%s，略高，可能需要提高阈值",
    "异常比例为%s，过高，检测效果可能不理想",
]
FACTOR_CV = [
    "分数变异系数高，表明模型对不同样本有很好的区分能力",
    "分数变异系数适中，模型有一定的区分能力",
    "分数变异系数低，模型对不同样本的区分能力有限",
]
FACTOR_LOF = [
    "LOF得分高，表明异常样本在特征空间中有明显的离群特性",
    "LOF得分一般，异常样本在特征空间中的离群特性不太明显",
]
ADVICE_THRESHOLD_HIGH = "考虑降低异常阈值，当前阈值可能过高"
ADVICE_THRESHOLD_LOW = "考虑提高异常阈值，当前阈值可能过低"
ADVICE_RATIO = "异常比例过高，建议重新调整模型或检测方法"
ADVICE_CV = "模型区分能力有限，建议尝试其他特征或检测方法"
ADVICE_FAIR = "建议尝试其他检测方法或调整特征提取"
ADVICE_WEAK = "建议重新训练模型或使用不同的检测方法"
ADVICE_FEATURES = "建议提供特征数据以进行更全面的评估"
ADVICE_TIMES = "建议提供时间戳数据以进行时间趋势分析"
ADVICE_TEXTS = "建议提供日志文本以生成Top-K异常样本报告"
