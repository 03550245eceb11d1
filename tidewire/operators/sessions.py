"""Packets folded into sessions, protocol counts and summaries.

The flat packet contract (a view over captures, or over any other timestamped flows)::

    seq long, ts_ns long, src string, src_port int, dst string, dst_port int, proto string, flags int,
    length long, original_length long, app string, n_errors int, interface_id long, vlan int

All are hash aggregates with partial sums before the shuffle; a session with a third of the packets costs its
partition one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare_syn, flags_to_mask, floor_div, ip_key, session_key, syn_ack

TRANSPORTS = ("tcp", "udp", "icmp", "icmpv6")


def flat_packets(packets: DataFrame, *more: Column) -> DataFrame:
    """The flat contract of decoded packets, and ``more`` of their columns. ICMP has port 0 on both sides; ARP has no endpoints."""
    net, tp = F.col("network"), F.col("transport")
    is_ip = net["protocol"] != "arp"
    return packets.select(
        F.col("packet_index").alias("seq"),
        "ts_ns",
        F.when(is_ip, net["src"]).alias("src"),
        F.when(is_ip, F.coalesce(tp["src_port"], F.lit(0))).alias("src_port"),
        F.when(is_ip, net["dst"]).alias("dst"),
        F.when(is_ip, F.coalesce(tp["dst_port"], F.lit(0))).alias("dst_port"),
        net["protocol"].alias("proto"),
        F.coalesce(flags_to_mask(tp["flags"]), F.lit(0)).alias("flags"),
        F.col("captured_len").alias("length"),
        F.col("original_len").alias("original_length"),
        F.col("application")["protocol"].alias("app"),
        F.size("errors").alias("n_errors"),
        "interface_id",
        F.get(F.col("link")["vlan_ids"], F.lit(0)).alias("vlan"),
        net["ip_version"].alias("ip_version"),
        F.col("link").isNotNull().alias("has_link"),
        *more,
    )


def canonical(packets: DataFrame) -> DataFrame:
    """Adds a_ip, a_port, b_ip, b_port and from_a: the lesser endpoint is a, by address order and then port."""
    src = F.struct(ip_key("src").alias("k"), F.col("src_port").alias("port"))
    dst = F.struct(ip_key("dst").alias("k"), F.col("dst_port").alias("port"))
    first = src <= dst
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return packets.withColumns({"a_ip": pick("src", "dst"), "a_port": pick("src_port", "dst_port"), "b_ip": pick("dst", "src"), "b_port": pick("dst_port", "src_port"), "from_a": first})


KEY = ["proto", "a_ip", "a_port", "b_ip", "b_port"]


def sessions(packets: DataFrame) -> DataFrame:
    """One row for each canonical five-tuple.

    The client is the sender of the last bare SYN (basis syn_first), or else of the first packet (first_seen). First
    seen attributes go by seq, times by the least and greatest.
    """
    own = canonical(packets.where("proto IN ('tcp','udp','icmp','icmpv6') AND src IS NOT NULL AND dst IS NOT NULL"))
    count = lambda c: F.count_if(c).cast("long")
    bytes_of = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0)).cast("long")
    a = F.col("from_a")
    syn = bare_syn("flags") & (F.col("proto") == "tcp")
    out = own.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum("length").cast("long").alias("bytes"),
        count(a).alias("a_packets"),
        bytes_of(a).alias("a_bytes"),
        count(~a).alias("b_packets"),
        bytes_of(~a).alias("b_bytes"),
        F.min("ts_ns").alias("first_ts"),
        F.max("ts_ns").alias("last_ts"),
        count(syn).alias("syn"),
        count(syn_ack("flags") & (F.col("proto") == "tcp")).alias("syn_ack"),
        count((F.col("flags").bitwiseAND(F.lit(4)) != 0) & (F.col("proto") == "tcp")).alias("rst"),
        count((F.col("flags").bitwiseAND(F.lit(1)) != 0) & (F.col("proto") == "tcp")).alias("fin"),
        F.min("seq").alias("first_seq"),
        F.expr("min_by(interface_id, seq)").alias("interface_id"),
        F.expr("min_by(vlan, seq)").alias("vlan"),
        F.expr("min_by(app, seq) FILTER (WHERE app IS NOT NULL)").alias("app"),
        F.expr("max_by(from_a, seq) FILTER (WHERE proto = 'tcp' AND (flags & 18) = 2)").alias("_syn_a"),
        F.expr("min_by(from_a, seq)").alias("_first_a"),
    )
    out = out.withColumn("client_is_a", F.coalesce("_syn_a", "_first_a")).withColumn("basis", F.when(F.col("_syn_a").isNotNull(), "syn_first").otherwise("first_seen"))
    out = out.withColumn("duration_s", (F.col("last_ts") - F.col("first_ts")) / 1e9)
    return out.withColumn("key", session_key(F.col("proto"), F.col("a_ip"), F.col("a_port"), F.col("b_ip"), F.col("b_port"))).drop("_syn_a", "_first_a")


#: Sessions are numbered in stretches of this many packets.
STRETCH = 1 << 20


def with_session_ids(frame: DataFrame) -> DataFrame:
    """S-000001 and on, in the order in which sessions were first seen.

    No window goes over all sessions: each begins at a packet of its own, so a stretch of packets has a bounded number
    of sessions to number, and only the stretches' counts (a row a million packets) are summed in one place.
    """
    cut = frame.withColumn("_stretch", floor_div("first_seq", STRETCH))
    counts = cut.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_stretch"), (F.sum("_n").over(Window.orderBy("_stretch")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_stretch").orderBy("first_seq"))
    return cut.join(before, "_stretch").withColumn("id", F.format_string("S-%06d", F.col("_before") + rank)).drop("_stretch", "_before")


def conversations(frame: DataFrame, sort: str = "bytes", limit: int = 20) -> DataFrame:
    """Sessions by bytes, packets or duration, ties by id; 0 means 20. A top-k, never a full sort."""
    column = {"bytes": "bytes", "packets": "packets", "duration": "duration_s"}[sort]
    return frame.orderBy(F.col(column).desc(), "id").limit(limit or 20)


def client_server(frame: DataFrame) -> DataFrame:
    """Adds the client's and the server's endpoint."""
    pick = lambda x, y: F.when(F.col("client_is_a"), F.col(x)).otherwise(F.col(y))
    return frame.withColumns({"client_ip": pick("a_ip", "b_ip"), "client_port": pick("a_port", "b_port"), "server_ip": pick("b_ip", "a_ip"), "server_port": pick("b_port", "a_port")})


def protocol_layers(packets: DataFrame) -> DataFrame:
    """(layer, protocol) of each packet's layers, one row each; the rows stay where they are.

    A packet without a layer has no row for it. ARP counts once, as (arp, arp).
    """
    version = F.when(F.col("src").contains(":"), "ipv6").otherwise("ipv4")
    arp = F.col("proto") == "arp"
    layers = F.array_compact(
        F.array(
            F.struct(F.lit("link").alias("layer"), F.lit("ethernet").alias("protocol")),
            F.when(arp, F.struct(F.lit("arp").alias("layer"), F.lit("arp").alias("protocol"))).when(F.col("src").isNotNull(), F.struct(version.alias("layer"), version.alias("protocol"))),
            F.when(F.col("proto").isin(*TRANSPORTS), F.struct(F.col("proto").alias("layer"), F.col("proto").alias("protocol"))),
            F.when(F.col("app").isNotNull(), F.struct(F.col("app").alias("layer"), F.col("app").alias("protocol"))),
        )
    )
    return packets.select("seq", "length", F.explode(layers).alias("l")).select("seq", "length", "l.layer", "l.protocol")


def protocol_stats(packets: DataFrame) -> DataFrame:
    return protocol_layers(packets).groupBy("layer", "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("length").cast("long").alias("bytes"), F.min("seq").alias("first_seq"))


def top_per_layer(stats: DataFrame, n: int = 20) -> DataFrame:
    """The protocols with most packets in each layer, ties by name. The table has a row for each protocol only."""
    w = Window.partitionBy("layer").orderBy(F.col("packets").desc(), "protocol")
    return stats.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


GROUPS = {"network": ("ipv4", "ipv6"), "application": ("dns", "http", "tls", "dhcp"), "transport": ("tcp", "udp", "icmp")}


def stats_of_layer(stats: DataFrame, layer: str = "transport", n: int = 20, compat: bool = True) -> DataFrame:
    """Counts of a layer or group of layers. As in the interface, transport leaves out icmpv6 unless ``compat`` is off."""
    names = GROUPS.get(layer, (layer,))
    if layer == "transport" and not compat:
        names = TRANSPORTS
    return top_per_layer(stats.where(F.col("layer").isin(*names)), n)


def capture_summary(packets: DataFrame, sessions_frame: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """One row about the whole capture. First and last time are those of the first and last packet in file order."""
    base = packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"),
        F.expr("min_by(ts_ns, seq)").alias("first_ts"),
        F.expr("max_by(ts_ns, seq)").alias("last_ts"),
        F.count_if(F.col("length") < F.col("original_length")).cast("long").alias("truncated"),
        F.count_if(F.col("n_errors") > 0).cast("long").alias("decode_errors"),
        *[F.count_if(F.col("proto") == p).cast("long").alias(p) for p in TRANSPORTS],
    )
    base = base.withColumn("duration_s", (F.col("last_ts") - F.col("first_ts")) / 1e9)
    if sessions_frame is not None:
        base = base.crossJoin(sessions_frame.agg(F.count(F.lit(1)).alias("sessions")))  # one row each
    if alerts is not None:
        base = base.crossJoin(alerts.agg(F.count(F.lit(1)).alias("alerts")))
    return base


def incomplete_sessions(frame: DataFrame) -> DataFrame:
    """The number of sessions (with ``state``) whose data could not be put together completely."""
    return frame.agg(F.count_if(F.col("state").isin("incomplete", "buffer_overflow")).alias("incomplete_sessions"))


def protocols_map(summary: DataFrame) -> DataFrame:
    """The summary's transport counts as a map of those there are."""
    pairs = F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).alias("value")) for p in TRANSPORTS])
    return summary.withColumn("protocols", F.map_from_entries(F.filter(pairs, lambda x: x["value"] > 0)))


def error_counts(errors: DataFrame, n: int | None = None) -> DataFrame:
    """Decode errors by layer and code, the most frequent first."""
    out = errors.groupBy("layer", "code").agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), "layer", "code")
    return out.limit(n) if n is not None else out


def decode_errors(packets: DataFrame, *more: str) -> DataFrame:
    """A row for each error of a packet, with ``more`` of the packet's columns."""
    return packets.select("packet_index", F.explode("errors").alias("e"), *more).select("packet_index", "e.*", *more)


def sessions_by_protocol(frame: DataFrame) -> DataFrame:
    return frame.groupBy("proto").agg(F.count(F.lit(1)).alias("sessions"), F.sum("bytes").cast("long").alias("bytes"))
