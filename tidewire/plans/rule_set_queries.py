"""Sets of rules in one pass, over a busy gateway that the flow view is turned into; their SQL takes rule by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rule_pass
from ..operators.rule_files import EXAMPLES, load_rules
from ..operators.sessions import sessions
from .flows import FLOWS_SQL, SESSIONS_SQL, flows
from .registry import query
from .rule_queries import DAY, _alerts_sql, _rule

#: Clients stand behind two addresses, a month passes in two minutes, and every second TCP packet asks for a connection.
_GATEWAY = [
    ("seq", "seq"),
    ("ts_ns", "ts_ns {/} 20000"),
    ("src", "CASE WHEN proto = 'arp' THEN NULL WHEN seq % 3 = 1 THEN src ELSE concat('10.9.0.', CAST((seq % 4) {/} 2 AS STRING)) END"),
    ("src_port", "src_port"),
    ("dst", "CASE WHEN proto = 'arp' THEN NULL WHEN seq % 3 = 1 THEN concat('10.9.0.', CAST((seq % 4) {/} 2 AS STRING)) ELSE '10.0.0.200' END"),
    ("dst_port", "CASE WHEN proto = 'tcp' AND seq % 3 <> 1 THEN CAST(1000 + seq % 997 AS INT) ELSE dst_port END"),
    ("proto", "proto"),
    ("flags", "CASE WHEN proto = 'tcp' AND seq % 2 = 0 THEN 2 ELSE flags END"),
    ("length", "length"),
    ("app", "app"),
    ("interface_id", "interface_id"),
    ("vlan", "vlan"),
    ("dns_entropy", "CASE WHEN proto = 'udp' THEN CAST(2 + seq % 4 AS DOUBLE) END"),
    ("dns_txt_len", "dns_txt_len"),
    ("tls_sni", "CASE WHEN proto = 'tcp' THEN concat('s', CAST(seq % 400 AS STRING)) END"),
    ("layer", "CASE WHEN seq % 4 = 0 THEN 'tcp' END"),
    ("code", "CASE WHEN seq % 4 = 0 THEN CASE WHEN seq % 3 = 0 THEN 'truncated_header' ELSE 'bad_length' END END"),
]


def _columns(spark: bool) -> str:
    fill = lambda e: e.replace("{/}", "div") if spark else e.replace("{/}", "//").replace("AS STRING", "AS VARCHAR")
    return ", ".join(f"{fill(e)} AS {name}" for name, e in _GATEWAY)


GATEWAY_SQL = f"{FLOWS_SQL.replace('flows AS', 'direct AS', 1)}, flows AS (SELECT {_columns(False)} FROM direct), {SESSIONS_SQL}"


def gateway(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(f"SELECT {_columns(True)} FROM {{flows}}", flows=flows(spark, d))


def _rule_sql(rule: str, severity: str, events: str, value: str, seconds: int, bound: str, final: str, cooldown: int = 60) -> str:
    """Alerts of one rule with the last look at each group; ``events`` gives (grp, seq, ts_ns, now_ns, x)."""
    window, quiet = seconds * 1_000_000_000, cooldown * 1_000_000_000
    held = "b.ts_ns >= {0}.ts_ns - %d AND (b.ts_ns < {0}.ts_ns OR (b.ts_ns = {0}.ts_ns AND b.seq <= {0}.seq))" % window
    return f"""
SELECT '{rule}' AS rule_id, '{severity}' AS severity, * FROM (
WITH RECURSIVE e AS ({events}),
v AS (SELECT a.grp, a.seq, a.ts_ns, a.now_ns, CAST({value} AS DOUBLE) AS value FROM e a JOIN e b ON a.grp = b.grp AND {held.format("a")} GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY now_ns, seq) AS k FROM v WHERE value {bound}),
walk AS (
    SELECT * FROM c WHERE k = 1
    UNION ALL
    SELECT n.* FROM (SELECT w.grp, min(c.k) AS k FROM walk w JOIN c ON c.grp = w.grp AND c.k > w.k AND c.now_ns >= w.now_ns + {quiet} GROUP BY w.grp) m JOIN c n ON n.grp = m.grp AND n.k = m.k
), fired AS (
    SELECT grp, seq, ts_ns, now_ns, value FROM walk
    UNION ALL
    SELECT l.grp, l.seq, l.ts_ns, f.final, l.value
    FROM (SELECT grp, arg_max(seq, (ts_ns, seq)) AS seq, max(ts_ns) AS ts_ns, arg_max(value, (ts_ns, seq)) AS value FROM v GROUP BY grp) l
    JOIN (SELECT grp, max(now_ns) AS fired FROM walk GROUP BY grp) w ON w.grp = l.grp CROSS JOIN ({final}) f
    WHERE l.value {bound} AND f.final >= w.fired + {quiet}
)
SELECT f.grp, f.seq, f.now_ns, f.value, min(b.ts_ns) AS first_ts, max(b.ts_ns) AS last_ts, min(b.seq) AS first_packet, max(b.seq) AS last_packet
FROM fired f JOIN e b ON f.grp = b.grp AND {held.format("f")} GROUP BY f.grp, f.seq, f.now_ns, f.value)"""


def _of(grp: str, where: str, x: str = "NULL") -> str:
    return f"SELECT {grp} AS grp, seq, ts_ns, ts_ns AS now_ns, {x} AS x FROM flows WHERE {where}"


_SRC, _SYN = "'src_ip=' || coalesce(src, '')", "proto = 'tcp' AND (flags & 2) <> 0 AND (flags & 16) = 0"
_END = "SELECT max(ts_ns) AS final FROM flows"
SHIPPED_SQL = [
    _rule_sql("NET-TCP-SYN-BURST-001", "high", _of(_SRC, _SYN), "count(*)", 10, "> 100", _END),
    _rule_sql("NET-TCP-PORT-SWEEP-001", "medium", _of(_SRC + " || '|dst_ip=' || coalesce(dst, '')", _SYN + " AND dst_port IS NOT NULL", "dst_port"), "count(DISTINCT b.x)", 30, "> 50", _END),
    _rule_sql("NET-DNS-SUSPICIOUS-001", "medium", _of(_SRC, "proto = 'udp' AND dst_port = 53 AND dns_entropy > 3.5"), "count(*)", 60, "> 200", _END),
    _rule_sql("NET-MALFORMED-BURST-001", "low", "SELECT 'decode_code=' || code AS grp, seq, CAST(0 AS BIGINT) AS ts_ns, ts_ns AS now_ns, NULL AS x FROM flows WHERE code IS NOT NULL", "count(*)", 10, "> 500", "SELECT max(ts_ns) AS final FROM flows WHERE code IS NOT NULL"),
    _rule_sql("NET-DNS-TUNNEL-RATIO-001", "medium", _of("'dst_ip=' || coalesce(dst, '')", "proto = 'udp' AND src_port = 53 AND dns_txt_len IS NOT NULL", "dns_txt_len"), "CAST(count(*) FILTER (WHERE b.x > 100) AS DOUBLE) / count(*)", 60, "> 0.5", _END),
    _rule_sql("NET-TLS-SNI-DISTINCT-001", "low", _of(_SRC, "proto = 'tcp'", "tls_sni"), "count(DISTINCT b.x)", 60, "> 100", _END),
    _rule_sql("NET-SESSION-INCOMPLETE-001", "info", "SELECT 'session=' || key AS grp, CAST(0 AS BIGINT) AS seq, first_ts AS ts_ns, last_ts AS now_ns, NULL AS x FROM sessions WHERE proto = 'tcp'", "count(*)", 60, ">= 1", "SELECT max(last_ts) AS final FROM sessions"),
]


@query(f"WITH {GATEWAY_SQL} " + " UNION ALL ".join(SHIPPED_SQL))
def builtin_rules(spark, d):
    """The four built-in rules and the three examples, over packets, errors and sessions, with evidence."""
    own = gateway(spark, d)
    errors = own.where("code IS NOT NULL").select("seq", "ts_ns", "layer", "code")
    found = rule_pass.evaluate_all(own, load_rules(EXAMPLES), errors, sessions(own))
    return found.select("rule_id", "severity", "grp", "seq", "now_ns", "value", "first_ts", "last_ts", "first_packet", "last_packet")


_FROM = "SELECT 'src_ip=' || coalesce(src, '') AS grp, seq, ts_ns, length AS bytes, {x} AS x FROM flows WHERE {where}"
_MANY = [
    ("FLOW-COUNT-001", _alerts_sql(_FROM.format(x="NULL", where="proto = 'tcp'"), "count(*)", 2 * DAY, ">", 4, DAY), {"match": {"protocol": "tcp"}}),
    ("FLOW-BYTES-001", _alerts_sql(_FROM.format(x="NULL", where="src_port = 443 OR dst_port = 443"), "CAST(sum(b.bytes) AS BIGINT)", DAY, ">", 3000, DAY), {"window_ns": DAY, "metric": "sum_bytes", "field": "captured_len", "value": 3000, "match": {"any_port": 443}}),
    ("FLOW-TARGETS-001", _alerts_sql(_FROM.format(x="dst", where="proto = 'tcp' AND dst IS NOT NULL"), "count(DISTINCT b.x)", 3 * DAY, ">", 5, 0), {"window_ns": 3 * DAY, "metric": "distinct_count", "field": "dst_ip", "value": 5, "cooldown_ns": 0, "match": {"protocol": "tcp"}}),
    ("FLOW-RARE-001", _alerts_sql(_FROM.format(x="NULL", where="proto = 'icmp'"), "count(*)", 5 * DAY, "<=", 1, 2 * DAY), {"window_ns": 5 * DAY, "operator": "lte", "value": 1, "cooldown_ns": 2 * DAY, "match": {"protocol": "icmp"}}),
]


def _one_sql(name: str, sql: str, settings: dict) -> str:
    """Without a cooldown all candidates fire."""
    rows = sql.replace("value FROM walk", "value FROM c") if settings.get("cooldown_ns") == 0 else sql
    return f"SELECT '{name}' AS rule_id, * FROM ({rows})"


@query(" UNION ALL ".join(_one_sql(*m) for m in _MANY))
def rules_in_one_pass(spark, d):
    """Rules of unlike windows, metrics and cooldowns over one scan of the flow view; one has no cooldown."""
    many = [_rule(id=name, group_by=("src_ip",), **k) for name, _, k in _MANY]
    return rule_pass.evaluate_together([(flows(spark, d), many)]).select("rule_id", "grp", "seq", "ts_ns", "value")
