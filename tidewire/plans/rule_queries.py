"""Windowed rules over the flow view, each beside the same computation in SQL by self-join and recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..operators.rule_files import Rule
from .flows import FLOWS_SQL, SESSIONS_SQL, flows
from .registry import query

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def _rule(**k) -> Rule:
    return Rule(**({"id": "FLOW-TEST-001", "window_ns": 2 * DAY, "operator": "gt", "value": 4.0, "cooldown_ns": DAY, "severity": "medium"} | k))


def _alerts_sql(events: str, value: str, window: int, operator: str, bound: float, cooldown: int, extra: str = "") -> str:
    """Alerts in SQL: ``events`` gives (grp, seq, ts_ns, bytes, x); the value is an aggregate over the window's rows b."""
    return f"""
WITH RECURSIVE {FLOWS_SQL}{extra}, e AS ({events}),
v AS (
    SELECT a.grp, a.seq, a.ts_ns, CAST({value} AS DOUBLE) AS value
    FROM e a JOIN e b ON a.grp = b.grp AND b.ts_ns >= a.ts_ns - {window} AND (b.ts_ns < a.ts_ns OR (b.ts_ns = a.ts_ns AND b.seq <= a.seq))
    GROUP BY a.grp, a.seq, a.ts_ns
), c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts_ns, seq) AS k FROM v WHERE value {operator} {bound}),
walk AS (
    SELECT grp, seq, ts_ns, value, k FROM c WHERE k = 1
    UNION ALL
    SELECT n.grp, n.seq, n.ts_ns, n.value, n.k
    FROM (SELECT w.grp, min(c.k) AS k FROM walk w JOIN c ON c.grp = w.grp AND c.k > w.k AND c.ts_ns >= w.ts_ns + {cooldown} GROUP BY w.grp) m JOIN c n ON n.grp = m.grp AND n.k = m.k
)
SELECT grp, seq, ts_ns, value FROM walk"""


def _out(frame):
    return frame.select("grp", "seq", "ts_ns", "value")


_SRC = "SELECT 'src_ip=' || coalesce(src, '') AS grp, seq, ts_ns, length AS bytes, {x} AS x FROM flows WHERE {where}"


@query(_alerts_sql(_SRC.format(x="NULL", where="proto = 'tcp'"), "count(*)", 2 * DAY, ">", 4, DAY))
def rule_count_window(spark, d):
    """More than 4 packets of one source within two days, a day's cooldown. The flagship query."""
    return _out(rules.evaluate(flows(spark, d), _rule(group_by=("src_ip",), match={"protocol": "tcp"})))


@query(_alerts_sql(_SRC.format(x="NULL", where="proto = 'tcp' AND (flags & 2) <> 0 AND (flags & 16) = 0"), "count(*)", 5 * DAY, ">=", 3, 2 * DAY))
def rule_syn_burst(spark, d):
    """a match by flags that must and mustn't be set."""
    return _out(rules.evaluate(flows(spark, d), _rule(window_ns=5 * DAY, value=3, operator="gte", cooldown_ns=2 * DAY, match={"protocol": "tcp", "flags": {"contains": ["SYN"], "excludes": ["ACK"]}})))


@query(_alerts_sql(_SRC.format(x="NULL", where="proto IN ('tcp', 'udp')").replace("WHERE", "WHERE (src_port = 443 OR dst_port = 443) AND"), "CAST(sum(b.bytes) AS BIGINT)", DAY, ">", 3000, DAY))
def rule_sum_bytes(spark, d):
    """Bytes in the window, either port."""
    return _out(rules.evaluate(flows(spark, d), _rule(window_ns=DAY, metric="sum_bytes", field="captured_len", value=3000, match={"any_port": 443})))


@query(_alerts_sql(_SRC.format(x="CAST(dst AS VARCHAR)", where="proto = 'tcp' AND dst IS NOT NULL"), "count(DISTINCT b.x)", 3 * DAY, ">", 5, DAY))
def rule_distinct_count(spark, d):
    """Distinct targets in the window, exactly, as begins less ends."""
    return _out(rules.evaluate(flows(spark, d), _rule(window_ns=3 * DAY, metric="distinct_count", field="dst_ip", value=5, match={"protocol": "tcp"})))


@query(_alerts_sql(_SRC.format(x="dns_txt_len", where="proto = 'udp' AND dns_txt_len IS NOT NULL").replace("'src_ip=' || coalesce(src, '')", "'dst_ip=' || coalesce(dst, '')"), "CAST(count(*) FILTER (WHERE b.x > 100) AS DOUBLE) / count(*)", 10 * DAY, ">", 0.5, 2 * DAY))
def rule_ratio(spark, d):
    """The share of answers with long texts; only packets that have the field count."""
    return _out(rules.evaluate(flows(spark, d), _rule(window_ns=10 * DAY, metric="ratio", field="dns.txt_len", field_gt=100, value=0.5, cooldown_ns=2 * DAY, group_by=("dst_ip",), match={"protocol": "udp", "src_port": 53})))


@query(_alerts_sql("SELECT 'src_ip=' || coalesce(src, '') || '|dst_ip=' || coalesce(dst, '') || '|protocol=' || proto AS grp, seq, ts_ns, length AS bytes, NULL AS x FROM flows", "count(*)", 6 * DAY, ">=", 3, DAY))
def rule_group_of_three(spark, d):
    """A group of several keys, missing values empty."""
    return _out(rules.evaluate(flows(spark, d), _rule(window_ns=6 * DAY, operator="gte", value=3, group_by=("src_ip", "dst_ip", "protocol"))))


@query(_alerts_sql("SELECT 'decode_code=' || coalesce(code, '') AS grp, seq, CAST(0 AS BIGINT) AS ts_ns, 0 AS bytes, NULL AS x FROM flows WHERE n_errors > 0", "count(*)", 10, ">", 20, 60_000_000_000).replace("c.ts_ns >= w.ts_ns + 60000000000", "FALSE"))
def rule_decode_scope(spark, d):
    """Decode errors have no time, so the count grows over the whole capture and fires once."""
    errors = flows(spark, d).where("n_errors > 0").select("seq", F.lit(0).cast("long").alias("ts_ns"), F.lit(0).cast("long").alias("now_ns"), "layer", "code")
    return _out(rules.evaluate(errors, _rule(window_ns=10, value=20, cooldown_ns=60_000_000_000, group_by=("decode_code",), match={"decode_layer": "any"})))


@query(_alerts_sql("SELECT 'protocol=' || proto AS grp, first_seq AS seq, first_ts AS ts_ns, 0 AS bytes, NULL AS x FROM sessions WHERE proto = 'tcp'", "count(*)", 3 * DAY, ">", 10, DAY, ", " + SESSIONS_SQL))
def rule_session_scope(spark, d):
    """The same operator over sessions."""
    from ..operators.sessions import sessions

    own = sessions(flows(spark, d)).select(F.col("first_seq").alias("seq"), F.col("first_ts").alias("ts_ns"), "proto", "key")
    return _out(rules.evaluate(own, _rule(window_ns=3 * DAY, value=10, scope="session", group_by=("protocol",), match={"protocol": "tcp"})))


_EV = _alerts_sql(_SRC.format(x="NULL", where="proto = 'tcp'"), "count(*)", 2 * DAY, ">", 4, DAY)


@query(_EV.replace("SELECT grp, seq, ts_ns, value FROM walk", f"SELECT w.grp, w.seq, w.value, min(b.ts_ns) AS first_ts, max(b.ts_ns) AS last_ts, min(b.seq) AS first_packet, max(b.seq) AS last_packet FROM walk w JOIN e b ON w.grp = b.grp AND b.ts_ns >= w.ts_ns - {2 * DAY} AND (b.ts_ns < w.ts_ns OR (b.ts_ns = w.ts_ns AND b.seq <= w.seq)) GROUP BY w.grp, w.seq, w.value"))
def rule_evidence(spark, d):
    """What each alert's window held."""
    return rules.evaluate(flows(spark, d), _rule(match={"protocol": "tcp"}), with_evidence=True).select("grp", "seq", "value", "first_ts", "last_ts", "first_packet", "last_packet")


@query(_EV.replace("SELECT grp, seq, ts_ns, value FROM walk", f"""
SELECT grp, seq, array_to_string(list_sort(list_distinct([q[1], q[CAST(floor((n - 1) / 4.0) AS INT) + 1], q[CAST(floor((n - 1) / 2.0) AS INT) + 1], q[CAST(floor((n - 1) * 3 / 4.0) AS INT) + 1], q[n]])), ',') AS samples
FROM (SELECT w.grp, w.seq, list(b.seq ORDER BY b.ts_ns, b.seq) AS q, CAST(count(*) AS INT) AS n FROM walk w JOIN e b ON w.grp = b.grp AND b.ts_ns >= w.ts_ns - {2 * DAY} AND (b.ts_ns < w.ts_ns OR (b.ts_ns = w.ts_ns AND b.seq <= w.seq)) GROUP BY w.grp, w.seq)"""))
def rule_evidence_samples(spark, d):
    """Up to five packets at even distances in the window."""
    out = rules.evaluate(flows(spark, d), _rule(match={"protocol": "tcp"}), with_evidence=True)
    return out.select("grp", "seq", F.concat_ws(",", F.transform("sample_packets", lambda x: x.cast("string"))).alias("samples"))


_FL = _alerts_sql(_SRC.format(x="NULL", where="proto = 'tcp'"), "count(*)", 2 * DAY, ">", 4, DAY)


@query(_FL.replace("SELECT grp, seq, ts_ns, value FROM walk", f"""
SELECT grp, seq, ts_ns AS now_ns, value FROM walk
UNION ALL
SELECT l.grp, l.seq, f.final AS now_ns, l.value
FROM (SELECT grp, arg_max(seq, (ts_ns, seq)) AS seq, arg_max(value, (ts_ns, seq)) AS value FROM v GROUP BY grp) l
JOIN (SELECT grp, max(ts_ns) AS fired FROM walk GROUP BY grp) w ON w.grp = l.grp CROSS JOIN (SELECT max(ts_ns) AS final FROM flows) f
WHERE l.value > 4 AND f.final >= w.fired + {DAY}"""))
def rule_flush(spark, d):
    """At the end each group's last window is looked at once more, with the capture's last time as now."""
    return rules.evaluate(flows(spark, d), _rule(match={"protocol": "tcp"}), flush=True).select("grp", "seq", "now_ns", "value")
