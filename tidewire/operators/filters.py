"""Filters over packets, conversations and alerts, with the bounds of the query interface."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FLAG_BITS, has_flags, same_ip

DEFAULT_LIMIT, MOST = 100, 10_000


@dataclass(frozen=True)
class PacketFilter:
    """All conditions hold together; what is None isn't asked. Addresses compare as text here."""

    src_ip: str | None = None
    dst_ip: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    protocol: str | None = None
    tcp_flags: tuple[str, ...] = ()
    time_from: float | None = None
    time_to: float | None = None
    decode_errors_only: bool = False
    known: frozenset[str] = field(default=frozenset(FLAG_BITS), repr=False)

    def column(self) -> Column:
        """The condition over the flat packet columns; each part can be pushed to the scan."""
        parts = [F.col(c) == v for c, v in (("src", self.src_ip), ("dst", self.dst_ip), ("src_port", self.src_port), ("dst_port", self.dst_port)) if v is not None]
        if self.protocol is not None:
            parts.append(F.lower("proto") == self.protocol.lower())
        flags = [f for f in self.tcp_flags if f.upper() in self.known]
        if flags:
            parts.append(has_flags("flags", *flags))
        if self.time_from is not None:
            parts.append(F.col("ts_ns") >= int(self.time_from * 1e9))
        if self.time_to is not None:
            parts.append(F.col("ts_ns") <= int(self.time_to * 1e9))
        if self.decode_errors_only:
            parts.append(F.coalesce(F.col("n_errors"), F.lit(0)) > 0)
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def filter_packets(packets: DataFrame, condition: PacketFilter, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first packets in file order that meet the condition; a limit under 1 counts as 1, one over 10,000 as that."""
    return packets.where(condition.column()).orderBy("seq").limit(min(max(limit, 1), MOST))


def filter_conversations(sessions: DataFrame, protocol: str | None = None, ip: str | None = None, min_bytes: int | None = None, min_packets: int | None = None) -> DataFrame:
    """Conversations by protocol, an address on either side (compared as an address), and size."""
    out = sessions
    if protocol is not None:
        out = out.where(F.lower("proto") == protocol.lower())
    if ip is not None:
        out = out.where(same_ip("a_ip", F.lit(ip)) | same_ip("b_ip", F.lit(ip)))
    if min_bytes is not None:
        out = out.where(F.col("bytes") >= min_bytes)
    if min_packets is not None:
        out = out.where(F.col("packets") >= min_packets)
    return out


def filter_alerts(alerts: DataFrame, severity: str | None = None, rule_id: str | None = None, session_id: str | None = None, stored: bool = False, limit: int = 50) -> DataFrame:
    """Alerts by severity (any case, but exact in stored ones), rule and session, the earliest first."""
    out = alerts
    if severity is not None:
        out = out.where(F.col("severity") == severity if stored else F.lower("severity") == severity.lower())
    if rule_id is not None:
        out = out.where(F.col("rule_id") == rule_id)
    if session_id is not None:
        out = out.where(F.col("session_id") == session_id)
    return out.orderBy("first_ts", "id").limit(limit)


def threshold_met(value: Column, operator: str, bound: float) -> Column:
    """Comparison with a threshold; eq and neq allow for a double's epsilon."""
    near = F.abs(value - bound) < 2.220446049250313e-16
    return {"gt": value > bound, "gte": value >= bound, "lt": value < bound, "lte": value <= bound, "eq": near, "neq": ~near}[operator]


def port_condition(port: Column, spec) -> Column:
    """A number, or gte, lte, eq and in together; a missing port never fits."""
    if isinstance(spec, int):
        out = port == spec
    else:
        tests = {"gte": lambda v: port >= v, "lte": lambda v: port <= v, "eq": lambda v: port == v, "in": lambda v: port.isin(*v)}
        out = F.lit(True)
        for k, v in spec.items():
            out = out & tests[k](v)
    return F.coalesce(out & port.isNotNull(), F.lit(False))
