"""Filters, sessions, counts and orders over the flow view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import filters, sessions
from .flows import FLOWS_SQL, LAYERS_SQL, SESSIONS_SQL, as_sql_ids, flows
from .registry import query

W = f"WITH {FLOWS_SQL} "
WS = f"WITH {FLOWS_SQL}, {SESSIONS_SQL} "
WL = f"WITH {FLOWS_SQL}, {LAYERS_SQL} "
SHORT = ["seq", "ts_ns", "src", "src_port", "dst", "dst_port", "proto", "flags", "length"]
S = ", ".join(SHORT)


def _s(spark: SparkSession, d: str) -> DataFrame:
    return as_sql_ids(sessions.with_session_ids(sessions.sessions(flows(spark, d))))


@query(W + f"SELECT {S} FROM flows WHERE dst = '10.0.0.201' AND dst_port = 443 AND lower(proto) = 'tcp' ORDER BY seq LIMIT 100")
def filter_by_endpoint(spark, d):
    """exact address, port and protocol in any case, the first 100 in file order."""
    return filters.filter_packets(flows(spark, d), filters.PacketFilter(dst_ip="10.0.0.201", dst_port=443, protocol="TCP")).select(*SHORT)


@query(W + f"SELECT {S} FROM flows WHERE (flags & 18) = 18 ORDER BY seq LIMIT 10000")
def filter_by_flags(spark, d):
    """all named flags set; unknown names are ignored; the limit is capped."""
    return filters.filter_packets(flows(spark, d), filters.PacketFilter(tcp_flags=("SYN", "ACK", "NOPE")), 50_000).select(*SHORT)


@query(W + f"SELECT {S} FROM flows WHERE ts_ns >= 1704240000000000000 AND ts_ns <= 1704499200000000000 AND n_errors > 0 ORDER BY seq LIMIT 1000")
def filter_by_time_and_errors(spark, d):
    """inclusive range in seconds, and packets with decode errors only."""
    return filters.filter_packets(flows(spark, d), filters.PacketFilter(time_from=1704240000, time_to=1704499200, decode_errors_only=True), 1000).select(*SHORT)


@query(W + "SELECT seq, length, original_length FROM flows WHERE length < original_length")
def filter_truncated(spark, d):
    """F12."""
    return flows(spark, d).where("length < original_length").select("seq", "length", "original_length")


@query(W + "SELECT seq, (flags & 18) = 2 AS bare_syn, (flags & 18) = 18 AS syn_ack, (flags & 4) <> 0 AS rst, (flags & 1) <> 0 AS fin FROM flows WHERE proto = 'tcp'")
def flag_predicates(spark, d):
    """F13."""
    f = F.col("flags")
    return flows(spark, d).where("proto = 'tcp'").select("seq", X.bare_syn(f).alias("bare_syn"), X.syn_ack(f).alias("syn_ack"), (f.bitwiseAND(F.lit(4)) != 0).alias("rst"), (f.bitwiseAND(F.lit(1)) != 0).alias("fin"))


@query(W + "SELECT seq, (src_port IN (53, 443)) IS TRUE AS listed, (dst_port >= 22 AND dst_port <= 100) IS TRUE AS ranged FROM flows")
def port_conditions(spark, d):
    """F8: a list and a range; a missing port never fits."""
    return flows(spark, d).select("seq", filters.port_condition(F.col("src_port"), {"in": [53, 443]}).alias("listed"), filters.port_condition(F.col("dst_port"), {"gte": 22, "lte": 100}).alias("ranged"))


_SESSION_COLUMNS = ["id", "proto", "a_ip", "a_port", "b_ip", "b_port", "packets", "bytes", "a_packets", "a_bytes", "b_packets", "b_bytes", "first_ts", "last_ts", "syn", "syn_ack", "rst", "fin", "interface_id", "vlan", "app", "client_is_a", "basis", "duration_s", "key"]


@query(WS + f"SELECT {', '.join(_SESSION_COLUMNS)} FROM sessions")
def session_table(spark, d):
    """A1 to A5 and the ids: all sessions, by canonical endpoints."""
    return _s(spark, d).select(*_SESSION_COLUMNS)


@query(WS + "SELECT id, bytes, packets FROM sessions ORDER BY bytes DESC, id LIMIT 20")
def conversations_by_bytes(spark, d):
    """L1."""
    return sessions.conversations(_s(spark, d), "bytes", 0).select("id", "bytes", "packets")


@query(WS + "SELECT id, packets FROM sessions ORDER BY packets DESC, id LIMIT 50")
def conversations_by_packets(spark, d):
    """L1."""
    return sessions.conversations(_s(spark, d), "packets", 50).select("id", "packets")


@query(WS + "SELECT id, duration_s FROM sessions ORDER BY duration_s DESC, id LIMIT 30")
def conversations_by_duration(spark, d):
    """L1."""
    return sessions.conversations(_s(spark, d), "duration", 30).select("id", "duration_s")


@query(WS + "SELECT id, a_ip, b_ip, bytes FROM sessions WHERE proto = 'udp' AND (a_ip = '10.0.0.203' OR b_ip = '10.0.0.203') AND bytes >= 500 AND packets >= 2")
def conversation_filter(spark, d):
    """F4."""
    return filters.filter_conversations(_s(spark, d), "UDP", "10.0.0.203", 500, 2).select("id", "a_ip", "b_ip", "bytes")


@query(WS + "SELECT id, CASE WHEN client_is_a THEN a_ip ELSE b_ip END AS client_ip, CASE WHEN client_is_a THEN a_port ELSE b_port END AS client_port, CASE WHEN client_is_a THEN b_ip ELSE a_ip END AS server_ip, CASE WHEN client_is_a THEN b_port ELSE a_port END AS server_port FROM sessions")
def session_client_server(spark, d):
    """A4 as the interface shows it."""
    return sessions.client_server(_s(spark, d)).select("id", "client_ip", "client_port", "server_ip", "server_port")


@query(WS + "SELECT proto, count(*) AS sessions, CAST(sum(bytes) AS BIGINT) AS bytes FROM sessions GROUP BY proto")
def sessions_by_protocol(spark, d):
    """A12."""
    return sessions.sessions_by_protocol(_s(spark, d))


@query(WS + "SELECT f.seq, s.id AS session_id FROM keyed f JOIN sessions s ON f.proto = s.proto AND f.a_ip = s.a_ip AND f.a_port = s.a_port AND f.b_ip = s.b_ip AND f.b_port = s.b_port")
def packet_session_lookup(spark, d):
    """Each packet's session."""
    own = sessions.canonical(flows(spark, d).where("proto IN ('tcp','udp','icmp','icmpv6') AND src IS NOT NULL"))
    return own.join(_s(spark, d).select(*sessions.KEY, F.col("id").alias("session_id")), sessions.KEY).select("seq", "session_id")


@query(WL + "SELECT layer, protocol, packets, bytes FROM stats")
def protocol_stats(spark, d):
    """A6."""
    return sessions.protocol_stats(flows(spark, d)).drop("first_seq")


@query(WL + "SELECT layer, protocol, packets FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY packets DESC, protocol) AS r FROM stats) WHERE r <= 1")
def protocol_top_per_layer(spark, d):
    """L2."""
    return sessions.top_per_layer(sessions.protocol_stats(flows(spark, d)), 1).select("layer", "protocol", "packets")


@query(WL + "SELECT layer, protocol, packets, bytes FROM stats ORDER BY bytes DESC, first_seq LIMIT 20")
def protocol_event_top(spark, d):
    """L3, L4: by bytes, ties as first seen."""
    return sessions.protocol_stats(flows(spark, d)).orderBy(F.col("bytes").desc(), "first_seq").limit(20).drop("first_seq")


@query(WL + "SELECT layer, protocol, packets, bytes FROM stats WHERE layer IN ('tcp', 'udp', 'icmp')")
def protocol_transport_group(spark, d):
    """The transport group leaves out icmpv6, as the interface does."""
    return sessions.stats_of_layer(sessions.protocol_stats(flows(spark, d)), "transport").drop("first_seq")


@query(WL + "SELECT layer, protocol, packets, bytes FROM stats WHERE layer IN ('dns', 'http', 'tls', 'dhcp') UNION ALL SELECT layer, protocol, packets, bytes FROM stats WHERE layer IN ('ipv4', 'ipv6')")
def protocol_layer_union(spark, d):
    """Application and network groups one after the other."""
    stats = sessions.protocol_stats(flows(spark, d))
    return sessions.stats_of_layer(stats, "application").unionByName(sessions.stats_of_layer(stats, "network")).drop("first_seq")


@query(W + "SELECT count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, arg_min(ts_ns, seq) AS first_ts, arg_max(ts_ns, seq) AS last_ts, count(*) FILTER (WHERE length < original_length) AS truncated, count(*) FILTER (WHERE n_errors > 0) AS decode_errors, count(*) FILTER (WHERE proto = 'tcp') AS tcp, count(*) FILTER (WHERE proto = 'udp') AS udp, count(*) FILTER (WHERE proto = 'icmp') AS icmp, count(*) FILTER (WHERE proto = 'icmpv6') AS icmpv6, (arg_max(ts_ns, seq) - arg_min(ts_ns, seq)) / 1e9 AS duration_s FROM flows")
def capture_summary(spark, d):
    """A8, A9."""
    return sessions.capture_summary(flows(spark, d))


@query(W + "SELECT layer, code, count(*) AS \"count\" FROM flows WHERE n_errors > 0 GROUP BY layer, code ORDER BY 3 DESC, 1, 2")
def decode_error_counts(spark, d):
    """A7."""
    return sessions.error_counts(flows(spark, d).where("n_errors > 0"))


@query(W + "SELECT proto, length, count(*) AS n, grouping(proto) AS g_proto, grouping(length) AS g_length FROM (SELECT proto, length % 4 AS length FROM flows) GROUP BY GROUPING SETS ((proto), (length), (proto, length), ())")
def extension_grouping_sets(spark, d):
    """Beyond the interface: several groupings in one pass."""
    own = flows(spark, d).selectExpr("proto", "length % 4 AS length")
    return spark.sql("SELECT proto, length, count(*) AS n, CAST(grouping(proto) AS BIGINT) AS g_proto, CAST(grouping(length) AS BIGINT) AS g_length FROM {own} GROUP BY GROUPING SETS ((proto), (length), (proto, length), ())", own=own)


@query(W + "SELECT src FROM flows WHERE proto = 'tcp' INTERSECT SELECT src FROM flows WHERE proto = 'udp'")
def set_intersect(spark, d):
    """Set operations, which the SQL surface offers."""
    f = flows(spark, d)
    return f.where("proto = 'tcp'").select("src").intersect(f.where("proto = 'udp'").select("src"))


@query(W + "SELECT dst FROM flows WHERE proto = 'tcp' AND src_port = 443 EXCEPT SELECT dst FROM flows WHERE proto = 'udp'")
def set_except(spark, d):
    f = flows(spark, d)
    return f.where("proto = 'tcp' AND src_port = 443").select("dst").subtract(f.where("proto = 'udp'").select("dst"))


@query("WITH c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase') SELECT p.event_id, arg_max(c.event_id, c.ts) AS click_id FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY p.event_id")
def extension_as_of_join(spark, d):
    """Beyond the interface: each purchase with the user's last click before it. One sort of both sides, no range join."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type IN ('click', 'purchase')").select("user_id", "event_id", "ts", "event_type")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("click_id", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "click_id")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS first_ts, count(*) AS events FROM s GROUP BY user_id, k")
def extension_session_windows(spark, d):
    """Beyond the interface: activity that pauses for over a day at most, the batch form of idle expiry."""
    e = spark.read.parquet(f"{d}/events.parquet")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    cut = e.select("user_id", "ts", F.when(F.coalesce(gap <= F.expr("INTERVAL 1 DAY"), F.lit(False)), 0).otherwise(1).alias("n"))
    k = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut.withColumn("k", k).groupBy("user_id", "k").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("events")).drop("k")


@query(W + "SELECT i.pos, f.seq, f.length FROM (SELECT unnest(range(0, 40)) AS pos) i JOIN flows f ON f.seq = (i.pos * 37) % 101 ORDER BY pos")
def packets_by_index(spark, d):
    """The list's order, repeats kept."""
    from ..operators.evidence import packets_by_index as pick

    indices = spark.range(40).select(F.col("id").alias("pos"), (F.col("id") * 37 % 101).alias("packet_index"))
    return pick(flows(spark, d), indices).select("pos", "seq", "length")


@query(WS + "SELECT id, packets, bytes FROM (SELECT * FROM sessions ORDER BY bytes DESC, id LIMIT 40) ORDER BY packets DESC, id")
def stored_sessions_page(spark, d):
    """As the interface does it, a page by bytes that is then sorted by packets."""
    from ..operators.store import stored_sessions

    return stored_sessions(_s(spark, d), "packets", 40, compat=True).select("id", "packets", "bytes")


@query(W + "SELECT seq, " + ", ".join(f"CAST(length AS DOUBLE) {o} 640 AS {n}" for n, o in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="), ("eq", "="), ("neq", "<>"))) + " FROM flows")
def threshold_operators(spark, d):
    """F9."""
    value = F.col("length").cast("double")
    return flows(spark, d).select("seq", *[filters.threshold_met(value, n, 640.0).alias(n) for n in ("gt", "gte", "lt", "lte", "eq", "neq")])


@query(WS + "SELECT count(*) FILTER (WHERE fin = 0 AND rst = 0) AS open, count(*) FILTER (WHERE basis = 'syn_first') AS known, (SELECT max(ts_ns) FROM flows) - max(last_ts) AS quiet_ns FROM sessions WHERE proto = 'tcp'")
def session_states(spark, d):
    """A10: sessions counted by how they stand."""
    last = flows(spark, d).agg(F.max("ts_ns").alias("now"))
    own = sessions.sessions(flows(spark, d)).where("proto = 'tcp'").agg(F.count_if((F.col("fin") == 0) & (F.col("rst") == 0)).alias("open"), F.count_if(F.col("basis") == "syn_first").alias("known"), F.max("last_ts").alias("l"))
    return own.crossJoin(last).select("open", "known", (F.col("now") - F.col("l")).alias("quiet_ns"))
