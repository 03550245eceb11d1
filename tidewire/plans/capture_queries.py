"""Frames made from the flow view, decoded, folded and reassembled again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reassembly, sessions
from ..operators.rule_files import load_rules
from ..schemas import RAW
from ..shared import materialize
from ..sources import synth
from ..sources.decode import decode
from .flows import FLOWS_SQL, SESSIONS_SQL, as_sql_ids, far, flows, off_wire, on_wire
from .registry import query

W = f"WITH {FLOWS_SQL} "
NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1, "icmpv6": 58}


def _mac(far: int, last: int) -> str:
    return f"02:{int(far).to_bytes(4).hex(':')}:{last:02x}"


def _frame(r) -> bytes:
    vlans = () if pd.isna(r.vlan) else (int(r.vlan),)
    if r.proto == "arp":
        return synth.ethernet(synth.arp("10.0.0.1", "10.0.0.2"), 0x0806, vlans)
    data = b"x" * (int(r.length) % 50)
    if r.proto == "tcp":
        body = synth.tcp(int(r.src_port), int(r.dst_port), int(r.seq) * 1000, 0, int(r.flags), data)
    elif r.proto == "udp":
        body = synth.udp(int(r.src_port), int(r.dst_port), synth.dns_query(f"n{int(r.seq)}.example.com", int(r.seq) & 0xFFFF))
    else:
        body = synth.icmp(8, 0, data)
    return synth.ethernet(synth.ipv4(body, r.src, r.dst, NUMBERS[r.proto]), vlans=vlans, src=_mac(r.src_far, 1), dst=_mac(r.dst_far, 2))


def framed(spark: SparkSession, d: str) -> DataFrame:
    """The flow view as raw records, in as many parts as there are cores, as captures come in many files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [_frame(r) for r in b.itertuples()]
            yield pd.DataFrame({"packet_index": b["seq"], "ts_ns": b["ts_ns"], "precision": "us", "interface_id": b["interface_id"], "linktype": 1, "captured_len": [len(x) for x in raw], "original_len": [len(x) for x in raw], "raw": raw})

    own = flows(spark, d).select("seq", "ts_ns", "src", "src_port", "dst", "dst_port", "proto", "flags", "length", "interface_id", "vlan")
    own = own.withColumns({f"{c}_far": far(F.col(c)) for c in ("src", "dst")} | {c: on_wire(F.col(c)) for c in ("src", "dst")})
    return own.repartition(spark.sparkContext.defaultParallelism, "seq").mapInPandas(rows, RAW)


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """The frames' packets with the view's own addresses, as users beyond four octets share those of the frames."""
    net, link = F.col("network"), F.col("link")
    own = net.withField("src", off_wire(net["src"], link["src_mac"])).withField("dst", off_wire(net["dst"], link["dst_mac"]))
    return decode(framed(spark, d)).withColumn("network", own)


@query(W + "SELECT seq, src, src_port, dst, dst_port, proto, flags, vlan, CASE WHEN proto = 'udp' AND (src_port = 53 OR dst_port = 53) THEN 'dns' END AS app, 0 AS n_errors FROM flows")
def decode_frames(spark, d):
    """What frames were made from comes out of the decoder again."""
    return sessions.flat_packets(decoded(spark, d)).select("seq", "src", "src_port", "dst", "dst_port", "proto", "flags", "vlan", "app", "n_errors")


@query(W + "SELECT seq, 'n' || seq || '.example.com' AS qname, CAST(seq & 65535 AS INT) AS transaction_id, 1 AS qtype, CAST(length('n' || seq || '.example.com') AS INT) AS qname_len FROM flows WHERE proto = 'udp'")
def decode_dns(spark, d):
    """D14."""
    dns = F.col("application.dns")
    return decode(framed(spark, d)).where("application.protocol = 'dns'").select(F.col("packet_index").alias("seq"), dns["qname"].alias("qname"), dns["transaction_id"].alias("transaction_id"), dns["qtype"].alias("qtype"), dns["qname_len"].alias("qname_len"))


@query(f"WITH {FLOWS_SQL}, {SESSIONS_SQL} SELECT id, packets, syn, syn_ack, rst, fin, client_is_a, basis FROM sessions")
def sessions_of_frames(spark, d):
    """Decoding and folding together give the flow view's own sessions."""
    folded = materialize(sessions.sessions(sessions.flat_packets(decoded(spark, d))), "sessions")  # numbering reads it twice
    own = sessions.with_session_ids(folded)
    return as_sql_ids(own).select("id", "packets", "syn", "syn_ack", "rst", "fin", "client_is_a", "basis")


@query(W + "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'link' ELSE 'ipv4' END AS layer, CASE WHEN seq % 3 = 0 THEN 'unsupported_linktype' ELSE 'truncated_header' END AS code FROM flows WHERE proto = 'tcp' AND seq % 3 <> 2")
def decode_failures(spark, d):
    """Unknown link types and headers that are cut off become error rows; a third of the frames are left whole."""
    raw = framed(spark, d).join(flows(spark, d).where("proto = 'tcp'").select(F.col("seq").alias("packet_index")), "packet_index")
    broken = raw.withColumn("linktype", F.when(F.col("packet_index") % 3 == 0, F.lit(147)).otherwise(F.col("linktype")).cast("long")).withColumn("raw", F.when(F.col("packet_index") % 3 == 1, F.substring("raw", 1, 24)).otherwise(F.col("raw")))
    return sessions.decode_errors(decode(broken)).select(F.col("packet_index").alias("seq"), "layer", "code")


def _trial(spark: SparkSession, d: str) -> DataFrame:
    """Segments of streams made from orders: each order's lines are its data, in pieces that overlap, repeat or come late."""
    l = spark.read.parquet(f"{d}/lineitem.parquet")  # noqa: E741
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")) - 1
    own = l.select("l_orderkey", k.cast("long").alias("k"))
    # Of five segments the third comes before the fourth's place is filled, and the last repeats it.
    at = F.floor(F.col("k") / 5) * 40 + F.element_at(F.array(*map(F.lit, [0, 10, 30, 20, 30])), (F.col("k") % 5 + 1).cast("int"))
    return own.select(F.concat(F.lit("tcp|"), F.col("l_orderkey").cast("string")).alias("key"), "k", F.col("k").alias("seq"), F.lit(True).alias("from_a"), (F.col("k") * 1000).alias("ts_ns"), (F.lit(4294967290) + at).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tcp_seq"), F.lit(False).alias("syn"), F.lit(True).alias("ack"), F.lit(False).alias("fin"), F.lit(False).alias("rst"), F.lit(b"0123456789").alias("data"))


@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), s AS (SELECT l_orderkey, n, unnest(range(0, n)) AS k FROM o)
SELECT 'tcp|' || l_orderkey AS key, k AS seq, CASE k % 5 WHEN 0 THEN 'in_order' WHEN 1 THEN 'in_order' WHEN 2 THEN 'buffered' WHEN 3 THEN 'in_order' ELSE 'retransmission' END AS verdict FROM s""")
def reassembly_verdicts(spark, d):
    """Late, early and repeated segments, across the wrap of sequence numbers."""
    return reassembly.verdicts(_trial(spark, d)).select("key", "seq", "verdict")


@query("""
SELECT 'tcp|' || l_orderkey AS key, CASE WHEN n % 5 = 3 THEN 'incomplete' ELSE 'active' END AS state,
    CAST(n // 5 * 40 + CASE n % 5 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 4 THEN 40 ELSE 20 END AS BIGINT) AS ready_bytes
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def reassembly_streams(spark, d):
    """State and bytes of each stream."""
    return reassembly.streams(_trial(spark, d)).select("key", "state", "ready_bytes")


@query("SELECT 'tcp|' || l_orderkey AS key, CASE WHEN n % 5 = 3 THEN 'incomplete' ELSE 'active' END AS state, 'timeout' AS reason FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) WHERE 5000 - (n - 1) * 1000 > 2500")
def idle_streams(spark, d):
    """Streams that were quiet for too long when the capture ended."""
    return reassembly.idle_streams(reassembly.streams(_trial(spark, d)), 5000, 2500).drop("from_client")


@query()
def builtin_rules_on_frames(spark, d):
    """R6 over the flow view's own frames."""
    from .engine import Task

    task = Task(spark, "task_flows", "flows", decoded(spark, d), load_rules())
    return task._alerts().select("id", "rule_id", "severity", "grp", "value", "first_packet", "last_packet")


@query(W + "SELECT seq, repeat('x', CAST(length % 50 AS INT)) AS data FROM flows WHERE proto = 'tcp' AND length % 50 > 0")
def payload_bytes(spark, d):
    """Payloads by reference."""
    own = decode(framed(spark, d)).where("network.protocol = 'tcp' AND payload_ref IS NOT NULL")
    return own.select(F.col("packet_index").alias("seq"), F.substring("raw", (F.col("payload_ref.offset") + 1).cast("int"), F.col("payload_ref.length").cast("int")).cast("string").alias("data"))


def _mixed_frame(seq: int) -> bytes:
    """One of four applications by the packet's number: HTTP and TLS over TCP, DHCP, and DNS over IPv6."""
    kind = seq % 4
    if kind == 3:
        body = synth.udp(53000, 53, synth.dns_query(f"q{seq}.example", seq & 0xFFFF))
        return synth.ethernet(synth.ipv6(body, "2001:db8::1", "2001:db8::2", 17), 0x86DD)
    if kind == 2:
        body, number = synth.udp(68, 67, synth.dhcp(3, f"10.{seq % 200}.1.2")), 17
    elif kind == 1:
        body, number = synth.tcp(40000, 443, 1, 0, 24, synth.client_hello(f"s{seq}.example")), 6
    else:
        body, number = synth.tcp(40000, 80, 1, 0, 24, f"GET /{seq} HTTP/1.1\r\nHost: h{seq}.example\r\n\r\n".encode()), 6
    return synth.ethernet(synth.ipv4(body, "10.0.0.1", "10.0.0.2", number))


@query(
    W
    + """SELECT seq, CASE seq % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'tls' WHEN 2 THEN 'dhcp' ELSE 'dns' END AS app,
    CASE seq % 4 WHEN 0 THEN 'h' || seq || '.example' WHEN 1 THEN 's' || seq || '.example' WHEN 2 THEN '10.' || (seq % 200) || '.1.2' ELSE 'q' || seq || '.example' END AS name,
    CASE WHEN seq % 4 = 3 THEN '2001:db8::1' ELSE '10.0.0.1' END AS src, CASE WHEN seq % 4 = 3 THEN 6 ELSE 4 END AS ip_version, 'ok' AS decode_status FROM flows"""
)
def decode_applications(spark, d):
    """HTTP, TLS, DHCP and DNS, the last over IPv6."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [_mixed_frame(int(k)) for k in b["seq"]]
            n = [len(x) for x in raw]
            yield pd.DataFrame({"packet_index": b["seq"], "ts_ns": b["ts_ns"], "precision": "us", "interface_id": 0, "linktype": 1, "captured_len": n, "original_len": n, "raw": raw})

    app = F.col("application")
    name = F.coalesce(app["http"]["host"], app["tls"]["sni"], app["dhcp"]["requested_ip"], app["dns"]["qname"])
    own = flows(spark, d).select("seq", "ts_ns").repartition(spark.sparkContext.defaultParallelism, "seq")
    packets = decode(own.mapInPandas(rows, RAW))
    return packets.select(F.col("packet_index").alias("seq"), app["protocol"].alias("app"), name.alias("name"), F.col("network.src").alias("src"), F.col("network.ip_version").cast("int").alias("ip_version"), "decode_status")


def _pieces(rows: DataFrame, at, from_a=None, data=b"0123456789") -> DataFrame:
    """``rows`` (key, k) as segments with ``data`` at offset ``at``, across the wrap of sequence numbers."""
    off = lambda: F.lit(False)
    return rows.select("key", F.col("k").alias("seq"), (from_a if from_a is not None else F.lit(True)).alias("from_a"), (F.col("k") * 1000).alias("ts_ns"), (F.lit(4294967290) + at).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tcp_seq"), off().alias("syn"), F.lit(True).alias("ack"), off().alias("fin"), off().alias("rst"), F.lit(data).alias("data"))


def _order_pieces(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.concat(F.lit("tcp|"), F.col("l_orderkey").cast("string")).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))


_ORDERS = "o AS (SELECT 'tcp|' || l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_ORDERS}, s AS (SELECT key, unnest(range(0, n)) AS k FROM o) SELECT key, k AS seq, CASE WHEN k = 0 THEN 'in_order' ELSE 'partial_overlap' END AS verdict, CASE WHEN k = 0 THEN 0 ELSE 4 END AS amount FROM s")
def reassembly_overlaps(spark, d):
    """T4: every segment but the first begins with four bytes that have been delivered."""
    return reassembly.verdicts(_pieces(_order_pieces(spark, d), F.col("k") * 6)).select("key", "seq", "verdict", F.col("amount").cast("int").alias("amount"))


@query(
    f"""WITH {_ORDERS}, b AS (SELECT key, n, CASE WHEN n // 2 >= 2 THEN 'incomplete' ELSE 'active' END AS state FROM o)
SELECT key, true AS from_client, 'active' AS state, CASE WHEN n // 2 >= 2 THEN 'incomplete' ELSE 'active' END AS session_state FROM b
UNION ALL SELECT key, false, state, state FROM b WHERE n // 2 >= 1"""
)
def reassembly_both_directions(spark, d):
    """One direction is whole, the other has a hole after each piece; the session has the worse state."""
    own = _pieces(_order_pieces(spark, d), F.floor(F.col("k") / 2) * F.when(F.col("k") % 2 == 0, 10).otherwise(20), F.col("k") % 2 == 0)
    return reassembly.streams(own).select("key", "from_client", "state", "session_state")


@query(f"WITH {_ORDERS} SELECT count(*) FILTER (WHERE n // 2 >= 2) AS incomplete_sessions FROM o")
def incomplete_sessions(spark, d):
    """A10, over the sessions with one whole direction and one with holes."""
    own = reassembly_both_directions(spark, d).groupBy("key").agg(F.first("session_state").alias("state"))
    return sessions.incomplete_sessions(own)


@query("SELECT 'tcp|' || r_regionkey AS key, 'active' AS state, CAST(20 * 1048576 AS BIGINT) AS ready_bytes FROM region")
def reassembly_long_streams(spark, d):
    """T5: 20 MiB in order are delivered, as the budget is for what waits."""
    rows = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("tcp|"), F.col("r_regionkey").cast("string")).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1279).cast("long"))).alias("k"))
    return reassembly.streams(_pieces(rows, F.col("k") * 16384, data=b"x" * 16384)).select("key", "state", "ready_bytes")
