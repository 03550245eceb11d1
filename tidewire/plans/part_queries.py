"""Captures written from the tables and read in parts."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import elephants, reassembly, rules
from ..shared import new_folder
from ..sources.capture import _store
from ..sources.capture_parts import scan_captures
from .capture_queries import _trial
from .flows import flows
from .registry import query
from .rule_queries import _SRC, DAY, _alerts_sql, _rule

#: Events of a file, and bytes of a part: a file is some tens of KB and is read in several parts.
FILE_EVENTS, PART_BYTES = 1000, 16 << 10
#: A section begins at each of these events of a file.
SECTION_EVENTS = 300


def _block(kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    n = struct.pack("<I", len(body) + 12)
    return struct.pack("<I", kind) + n + body + n


def _block_bytes(rows: list[tuple[int, bytes]]) -> bytes:
    """Sections with two interfaces (micro- and nanoseconds) that packets use in turn, the second described late."""
    one, two = (_block(1, struct.pack("<HHI", 147, 0, 0) + struct.pack("<HHB3xHH", 9, 1, x, 0, 0)) for x in (6, 9))
    out = []
    for k, (us, data) in enumerate(rows):
        at = k % SECTION_EVENTS
        if at == 0:
            out += [_block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)), one]
        elif at == 1:
            out.append(two)
        ticks = us * 1000 if at % 2 else us
        out.append(_block(6, struct.pack("<IIIII", at % 2, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data))
    return b"".join(out)


def _classic_bytes(rows: list[tuple[int, bytes]]) -> bytes:
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 147)
    return head + b"".join(struct.pack("<IIII", us // 10**6, us % 10**6, len(data), len(data)) + data for us, data in rows)


def _written(spark: SparkSession, d: str) -> str | None:
    """Events as captures, a thousand a file, the even files in blocks: the folder, or None without events."""
    folder = new_folder(spark, "captures")

    def write(table: pa.Table) -> pa.Table:
        (number,) = set(table.column("file").to_pylist())
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("event_id", "us", "props")], strict=True))
        packets = [(us, struct.pack(">q", k) + props.encode()) for k, us, props in rows]
        store, own = _store(folder)
        store.create_dir(own, recursive=True)
        name = f"{own}/{number:012d}.cap"
        with store.open_output_stream(name) as out:
            out.write(_classic_bytes(packets) if number % 2 else _block_bytes(packets))
        return pa.table({"file": pa.array([number], pa.int64()), "path": pa.array([f"{folder}/{number:012d}.cap"])})

    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("props", F.lit("")).alias("props"), F.expr(f"event_id div {FILE_EVENTS}").alias("file"))
    n = events.groupBy("file").applyInArrow(write, "file long, path string").count()
    return folder if n else None


@query(f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS us, coalesce(props, '') AS props, event_id // {FILE_EVENTS} AS file, row_number() OVER (PARTITION BY event_id // {FILE_EVENTS} ORDER BY event_id) - 1 AS k FROM events)
SELECT event_id, file, k AS packet_index, us * 1000 AS ts_ns, CASE WHEN file % 2 = 0 AND k % {SECTION_EVENTS} % 2 = 1 THEN 'ns' ELSE 'us' END AS precision,
    CASE WHEN file % 2 = 0 THEN k % {SECTION_EVENTS} % 2 ELSE 0 END AS interface_id, 147 AS linktype, 8 + strlen(props) AS captured_len, props FROM e""")
def capture_in_parts(spark, d):
    """Captures in both formats, with sections and interfaces described between packets, each file read in parts of 16 KiB."""
    folder = _written(spark, d)
    if folder is None:
        own = spark.createDataFrame([], "path string, packet_index long, ts_ns long, precision string, interface_id long, linktype long, captured_len long, raw binary")
    else:
        own = scan_captures(spark, f"{folder}/*.cap", PART_BYTES)
    return own.select(
        F.conv(F.hex(F.substring("raw", 1, 8)), 16, 10).cast("long").alias("event_id"),
        F.regexp_extract("path", r"(\d+)\.cap$", 1).cast("long").alias("file"),
        F.col("packet_index").cast("long").alias("packet_index"),
        "ts_ns",
        "precision",
        F.col("interface_id").cast("long").alias("interface_id"),
        F.col("linktype").cast("int").alias("linktype"),
        F.col("captured_len").cast("long").alias("captured_len"),
        F.col("raw").substr(F.lit(9), F.length("raw")).cast("string").alias("props"),
    )


def _one_session(spark: SparkSession, d: str):
    """All events as the segments of one session: of five the third comes before the fourth's place is filled, and the last repeats it."""
    k, off = F.col("event_id"), F.lit(False)
    at = F.expr("event_id div 5 * 40") + F.element_at(F.array(*map(F.lit, [0, 10, 30, 20, 30])), (k % 5 + 1).cast("int"))
    return spark.read.parquet(f"{d}/events.parquet").select(
        F.lit("tcp|all").alias("key"), k.alias("seq"), F.lit(True).alias("from_a"), (k * 1000).alias("ts_ns"), ((F.lit(4294967290) + at) % (1 << 32)).alias("tcp_seq"),
        off.alias("syn"), F.lit(True).alias("ack"), off.alias("fin"), off.alias("rst"), F.lit(b"0123456789").alias("data"),
    )


@query("""
SELECT event_id AS seq, CASE event_id % 5 WHEN 2 THEN 'buffered' WHEN 4 THEN 'retransmission' ELSE 'in_order' END AS verdict, CASE event_id % 5 WHEN 2 THEN 10 ELSE 0 END AS amount FROM events""")
def reassembly_one_session(spark, d):
    """One session with every segment there is, folded by many tasks."""
    return elephants.Reassembled(_one_session(spark, d), stretch=2048).verdicts().select("seq", "verdict", F.col("amount").cast("int").alias("amount"))


@query("""
SELECT 'tcp|all' AS key, CASE WHEN n % 5 = 3 THEN 'incomplete' ELSE 'active' END AS state,
    CAST(n // 5 * 40 + CASE n % 5 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 4 THEN 40 ELSE 20 END AS BIGINT) AS ready_bytes, CAST(CASE WHEN n % 5 = 3 THEN 1 ELSE 0 END AS BIGINT) AS holes
FROM (SELECT count(*) AS n FROM events) WHERE n > 0""")
def reassembly_one_session_streams(spark, d):
    """The state and holes of the same session."""
    found = elephants.Reassembled(_one_session(spark, d), stretch=2048).streams()
    return found.select("key", "state", "ready_bytes", F.size("missing").cast("long").alias("holes"))


_CAPPED = """
WITH f AS (SELECT l_orderkey, count(*) AS n, row_number() OVER (ORDER BY min(l_orderkey % 1000 * 100000000 + l_orderkey)) AS place FROM lineitem GROUP BY l_orderkey)"""


def _arriving(spark: SparkSession, d: str):
    """Streams of orders whose segments come at places of their own, orders mixed with one another."""
    order = F.split("key", "[|]")[1].cast("long")
    return _trial(spark, d).withColumn("seq", (order % 1000 * 100_000_000 + order) * 1000 + F.col("k"))


@query(_CAPPED + """
SELECT 'tcp|' || l_orderkey AS key, n AS segments, CASE WHEN place > 300 THEN n ELSE 0 END AS dropped FROM f""")
def reassembly_session_cap(spark, d):
    """After 300 sessions, by their first segments' places, segments of others are refused."""
    found = reassembly.capped_verdicts(_arriving(spark, d), 300)
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("verdict") == "dropped").alias("dropped"))


@query(_CAPPED + """
SELECT count(*) AS dropped_sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS dropped_segments FROM f WHERE place > 300""")
def reassembly_refused(spark, d):
    """The counter."""
    return reassembly.refused_counts(reassembly.capped_verdicts(_arriving(spark, d), 300))


_BLOCK = 200
_TURNED = f"seq // {_BLOCK} * {_BLOCK} + {_BLOCK - 1} - seq % {_BLOCK}"


@query(_alerts_sql(
    f"SELECT grp, seq, max(ts_ns) OVER (PARTITION BY grp ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ts_ns, bytes, x FROM (SELECT * REPLACE ({_TURNED} AS seq) FROM ({_SRC.format(x='NULL', where="proto = 'tcp'")}))",
    "count(*)", 2 * DAY, ">", 4, DAY,
))
def rule_count_by_arrival(spark, d):
    """Windows fed by arrival, over a capture in which each block of 200 packets came backwards; ts_ns is the time the window had then."""
    turned = flows(spark, d).withColumn("seq", F.expr(_TURNED.replace("//", "div")))
    found = rules.evaluate(turned, _rule(group_by=("src_ip",), match={"protocol": "tcp"}), compat=True)
    return found.select("grp", "seq", F.col("now_ns").alias("ts_ns"), "value")
