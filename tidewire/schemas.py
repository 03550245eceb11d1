"""Schemas of the engine's tables. Times are nanoseconds in a long; Spark's timestamps end at microseconds."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, I, B = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LINK = _s(src_mac=S, dst_mac=S, ethertype=I, vlan_ids=T.ArrayType(I), sll_protocol=I)
NETWORK = _s(src=S, dst=S, protocol=S, ip_version=T.ShortType(), ttl=T.ShortType(), hop_limit=T.ShortType(), is_fragment=B)
ICMP = _s(icmp_type=T.ShortType(), code=T.ShortType())
TRANSPORT = _s(src_port=I, dst_port=I, flags=T.ArrayType(S), seq=L, ack=L, window=I, udp_len=I, icmp=ICMP)
DNS = _s(transaction_id=I, is_response=B, qname=S, qtype=I, qname_len=I, max_label_len=I, entropy=T.FloatType(), txt_len=L, answer_count=I)
HTTP = _s(is_request=B, method=S, status_code=I, host=S, user_agent=S, content_length=L, connection=S)
TLS = _s(record_type=T.ShortType(), version=I, is_client_hello=B, sni=S)
DHCP = _s(message_type=T.ShortType(), dhcp_type=T.ShortType(), client_id=S, requested_ip=S)
APPLICATION = _s(protocol=S, dns=DNS, http=HTTP, tls=TLS, dhcp=DHCP)
PAYLOAD_REF = _s(packet_index=L, offset=L, length=L)
DECODE_ERROR = _s(layer=S, code=S, message=S)

#: A record as the reader finds it.
RAW = _s(packet_index=L, ts_ns=L, precision=S, interface_id=L, linktype=L, captured_len=L, original_len=L, raw=T.BinaryType())
#: A decoded packet.
PACKETS = T.StructType(
    [
        *RAW.fields[:-1],
        T.StructField("truncated", B),
        T.StructField("link", LINK),
        T.StructField("network", NETWORK),
        T.StructField("transport", TRANSPORT),
        T.StructField("application", APPLICATION),
        T.StructField("payload_ref", PAYLOAD_REF),
        T.StructField("decode_status", S),
        T.StructField("errors", T.ArrayType(DECODE_ERROR)),
        RAW.fields[-1],
    ]
)
EVIDENCE_REF = _s(_id=S, method=S, ref_id=S)
CLAIM = _s(_id=S, field=S, value=T.DoubleType())
DRAFT = _s(title=S, severity=S, basis=S, summary=S, evidence=T.ArrayType(EVIDENCE_REF), claims=T.ArrayType(CLAIM))
LEDGER = _s(id=S, task_id=S, method=S, ts_unix_ns=L, args_json=S, duration_ms=L, status=S, ref_ids=T.ArrayType(S), numbers=T.MapType(S, T.DoubleType()), tokens=T.ArrayType(S))

#: The stored tables with their keys. Keys of sessions and findings restart in each task, so the task is part of them.
STORED_KEYS = {
    "analysis_tasks": ["id"],
    "captures": ["task_id"],
    "sessions": ["task_id", "id"],
    "alerts": ["id"],
    "agent_runs": ["id"],
    "tool_calls": ["id"],
    "findings": ["task_id", "id"],
    "artifacts": ["id"],
}
#: What a second write of a key does: replace the row, or keep the first.
KEEP_FIRST = frozenset({"alerts", "tool_calls"})
