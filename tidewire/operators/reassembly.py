"""TCP streams put together again, direction by direction.

A direction is a set of byte intervals in the space of 32-bit sequence numbers, kept as offsets from the first byte
expected. Everything up to ``done`` has arrived; later intervals wait. Spark brings the segments of a session
together in file order (a sort, not a list), and the fold holds one session at a time within its budgets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the worst on.
STATES = ("buffer_overflow", "incomplete", "closed", "half_closed", "active", "new")
MAX_BYTES, MAX_SEGMENTS = 8 << 20, 4096
IDLE_NS = 60_000_000_000


@dataclass
class Limits:
    max_bytes: int = MAX_BYTES
    max_segments: int = MAX_SEGMENTS


def _start(piece: tuple[int, bytes]) -> int:
    return piece[0]


@dataclass
class Stream:
    """One direction. ``waiting`` has (offset, data) of what lies beyond a hole, apart and in order.

    The limits bound what waits; data in order go out at once, however many there are.
    """

    limits: Limits = field(default_factory=Limits)
    first_wins: bool = True
    keep: int | None = None
    base: int | None = None
    done: int = 0
    waiting: list[tuple[int, bytes]] = field(default_factory=list)
    ready: bytearray = field(default_factory=bytearray)
    ready_total: int = 0
    held: int = 0
    overflow: bool = False
    fin: bool = False
    rst: bool = False
    last_ts: int = 0

    def feed(self, seq: int, data: bytes, ts: int = 0, syn: bool = False, fin: bool = False, rst: bool = False) -> tuple[str, int]:
        """The verdict on a segment and its number: gap or dropped bytes."""
        if ts > self.last_ts:
            self.last_ts = ts
        self.fin, self.rst = self.fin or fin, self.rst or rst
        if not data:  # a bare SYN takes one number, a pure ACK none
            if self.base is None and syn:
                self.base = (seq + 1) & 0xFFFFFFFF
            return "in_order", 0
        if self.base is None:
            self.base = seq
        at = self.done + (((seq - self.base - self.done) + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)
        verdict = ("in_order", 0)
        if at < self.done:
            late = self.done - at
            if late >= len(data):
                return "retransmission", 0
            data, at, verdict = data[late:], self.done, ("partial_overlap", late)
        if at > self.done:
            verdict = ("buffered", at - self.done)
        if self._simple(at, data):
            return verdict
        new = self._place(at, data)
        if new < len(data):
            if not new:
                return "retransmission", 0
            verdict = ("partial_overlap", len(data) - new)
        self._bound()
        self._advance()
        return verdict

    def _simple(self, at: int, data: bytes) -> bool:
        """Takes in data within the limits that meet no other: next in order, or behind all that waits. The general way gives the same."""
        waiting, n = self.waiting, len(data)
        if self.held + n > self.limits.max_bytes or len(waiting) >= self.limits.max_segments:
            return False
        if at == self.done:
            if waiting and waiting[0][0] < at + n:
                return False
            self._deliver(data)
            if waiting and waiting[0][0] == self.done:
                self._advance()
            return True
        if waiting and waiting[-1][0] + len(waiting[-1][1]) > at:
            return False
        waiting.append((at, data))
        self.held += n
        return True

    def _place(self, at: int, data: bytes) -> int:
        """Puts in what is new and tells how many bytes that was. Where data meet, the first or the last copy stays."""
        end = at + len(data)
        lo = max(0, bisect_right(self.waiting, at, key=_start) - 1)
        if lo < len(self.waiting) and self.waiting[lo][0] + len(self.waiting[lo][1]) <= at:
            lo += 1
        hi = bisect_left(self.waiting, end, lo=lo, key=_start)
        met = self.waiting[lo:hi]
        kept, pieces, cursor = [], [], at
        for start, old in met:
            stop = start + len(old)
            if self.first_wins:
                if cursor < start:
                    pieces.append((cursor, data[cursor - at : start - at]))
                cursor = max(cursor, stop)
                kept.append((start, old))
            else:
                if start < at:
                    kept.append((start, old[: at - start]))
                if stop > end:
                    kept.append((end, old[end - start :]))
        if cursor < end:
            pieces.append((cursor, data[cursor - at :]))
        put = sorted(kept + pieces, key=_start)
        self.waiting[lo:hi] = put
        self.held += sum(len(d) for _, d in put) - sum(len(d) for _, d in met)
        return sum(len(p) for _, p in pieces)

    def _bound(self) -> None:
        while self.waiting and (self.held > self.limits.max_bytes or len(self.waiting) > self.limits.max_segments):
            _, gone = self.waiting.pop(0)
            self.held -= len(gone)
            self.overflow = True

    def _advance(self) -> None:
        k = 0
        while k < len(self.waiting) and self.waiting[k][0] == self.done:
            data = self.waiting[k][1]
            self.held -= len(data)
            self._deliver(data)
            k += 1
        del self.waiting[:k]

    def _deliver(self, data: bytes) -> None:
        self.done += len(data)
        self.ready_total += len(data)
        if self.keep is None:
            self.ready += data
        elif len(self.ready) < self.keep:
            self.ready += data[: self.keep - len(self.ready)]

    def missing(self) -> list[tuple[int, int]]:
        """Holes as [start, end) in sequence numbers."""
        out, cursor = [], self.done
        for start, data in self.waiting:
            if start > cursor:
                out.append(((self.base + cursor) & 0xFFFFFFFF, (self.base + start) & 0xFFFFFFFF))
            cursor = max(cursor, start + len(data))
        return out

    def state(self) -> str:
        if self.overflow:
            return "buffer_overflow"
        if self.waiting and self.missing():
            return "incomplete"
        if self.rst:
            return "closed"
        if self.fin:
            return "half_closed"
        return "active" if self.base is not None else "new"


def worst(*states: str) -> str:
    return min(states, key=STATES.index, default="new")


def tcp_segments(packets: DataFrame) -> DataFrame:
    """Decoded packets as segments with the session's canonical key and the sending side; fragments and others are left out."""
    from ..functions.scalars import session_key
    from .sessions import canonical, flat_packets

    data = F.when(F.col("payload_ref").isNotNull(), F.substring(F.col("raw"), (F.col("payload_ref.offset") + 1).cast("int"), F.col("payload_ref.length").cast("int"))).otherwise(F.lit(b""))
    flag = lambda name: F.array_contains("transport.flags", name)
    own = packets.where("network.protocol = 'tcp' AND NOT network.is_fragment AND transport.seq IS NOT NULL")
    flat = flat_packets(own, F.col("transport.seq").alias("tcp_seq"), flag("SYN").alias("syn"), flag("ACK").alias("ack"), flag("FIN").alias("fin"), flag("RST").alias("rst"), data.alias("data"))
    key = session_key(F.col("proto"), F.col("a_ip"), F.col("a_port"), F.col("b_ip"), F.col("b_port"))
    return canonical(flat).select("seq", "ts_ns", "tcp_seq", "syn", "ack", "fin", "rst", "data", "from_a", key.alias("key"))


VERDICTS = "key string, seq long, from_a boolean, direction string, verdict string, amount long"
STREAMS = "key string, from_client boolean, state string, session_state string, ready_bytes long, last_ts long, missing array<struct<start:long,end:long>>, data binary"


@dataclass
class _Session:
    """A session while its segments come, in file order.

    A segment belongs to the direction by the client known when it arrives: the last bare SYN's sender so far, or else
    the sender of the first segment.
    """

    client: bool
    streams: dict[bool, Stream] = field(default_factory=dict)


COLUMNS = ["key", "seq", "from_a", "ts_ns", "tcp_seq", "syn", "ack", "fin", "rst", "data"]
#: Rows, and bytes of data, of an Arrow batch that goes out.
BATCH, BATCH_BYTES = 10_000, 16 << 20


#: Flags of a segment as bits of one number; OPENS is a bare SYN, whose sender is the client.
SYN, FIN, RST, OPENS = 1, 2, 4, 8


def _together(segments: DataFrame, with_data: bool) -> DataFrame:
    """Sessions whole in a task and in file order. A session has to be folded in order; sessions spread by key.

    Data that nobody keeps stay where they are, and their length goes instead. The number of tasks is set: Spark would merge partitions by
    their bytes, and the fold's time goes by segments.
    """
    bit = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    opens = F.col("syn") & ~F.coalesce(F.col("ack"), F.lit(False))
    marks = bit(F.col("syn"), SYN) + bit(F.col("fin"), FIN) + bit(F.col("rst"), RST) + bit(opens, OPENS)
    data = F.col("data") if with_data else F.coalesce(F.length("data"), F.lit(0))
    spark = segments.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return segments.select("key", "seq", "from_a", "ts_ns", "tcp_seq", marks.alias("marks"), data.alias("data")).repartition(tasks, "key").sortWithinPartitions("key", "seq")


def _values(column: pa.Array) -> list:
    """A column as Python values; without nulls by numpy, which is a tenth of the time."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


class _Fold:
    """Folds segments in file order and holds one session at a time. Of data that nobody keeps there is a range of their length."""

    def __init__(self, limits: Limits, first_wins: bool, keep: int | None):
        self.settings, self.key, self.session = (limits, first_wins, keep), None, None

    def feed(self, batch: pa.RecordBatch, told: tuple[list, list, list] | None = None) -> Iterator[tuple[str, _Session]]:
        """Yields each session that ends in the batch; ``told`` takes side, verdict and amount of each segment."""
        key, own, settings, whole = self.key, self.session, self.settings, self.settings[-1] != 0
        for k, from_a, ts, tcp_seq, marks, data in zip(*(_values(batch.column(c)) for c in ("key", "from_a", "ts_ns", "tcp_seq", "marks", "data")), strict=True):
            if own is None or k != key:
                if own is not None:
                    yield key, own
                self.key, self.session = key, own = k, _Session(from_a)
            if marks & OPENS:
                own.client = from_a
            up = from_a == own.client
            stream = own.streams.get(up) or own.streams.setdefault(up, Stream(*settings))
            found = stream.feed(tcp_seq, data if whole else range(data), ts, marks & SYN > 0, marks & FIN > 0, marks & RST > 0)
            if told:
                told[0].append("client_to_server" if up else "server_to_client")
                told[1].append(found[0])
                told[2].append(found[1])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size_of=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows of any number of sessions in Arrow batches of bounded size."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size_of(row)
        if len(held) == BATCH or n > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_VERDICTS = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("from_a", pa.bool_()), ("direction", pa.string()), ("verdict", pa.string()), ("amount", pa.int64())])
_STREAMS = pa.schema(
    [("key", pa.string()), ("from_client", pa.bool_()), ("state", pa.string()), ("session_state", pa.string()), ("ready_bytes", pa.int64()), ("last_ts", pa.int64()), ("missing", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("data", pa.binary())]
)


def verdicts(segments: DataFrame, limits: Limits | None = None, first_wins: bool = True) -> DataFrame:
    """What became of each segment: in_order, buffered, retransmission or partial_overlap."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Fold(limits or Limits(), first_wins, 0)
        for batch in batches:
            told = [], [], []
            for _ in own.feed(batch, told):
                pass
            columns = [batch.column(c) for c in ("key", "seq", "from_a")] + [pa.array(v) for v in told]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _VERDICTS.types, strict=True)], schema=_VERDICTS)

    return _together(segments, with_data=False).mapInArrow(fold, VERDICTS)


def _ends(key: str, session: _Session) -> Iterator[tuple]:
    both = worst(*(s.state() for s in session.streams.values()))
    for up, s in sorted(session.streams.items(), reverse=True):
        yield key, up, s.state(), both, s.ready_total, s.last_ts, [{"start": a, "end": b} for a, b in s.missing()], bytes(s.ready)


def streams(segments: DataFrame, limits: Limits | None = None, first_wins: bool = True, keep: int | None = 0) -> DataFrame:
    """One row for each direction of each session, with up to ``keep`` bytes of its data (None: all)."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own = _Fold(limits or Limits(), first_wins, keep)
        for batch in batches:
            for ended in own.feed(batch):
                yield from _ends(*ended)
        if own.session:
            yield from _ends(own.key, own.session)

    return _together(segments, with_data=keep != 0).mapInArrow(lambda b: _batches(ends(b), _STREAMS, lambda row: len(row[-1])), STREAMS)


def with_verdict_counts(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Adds retransmissions and out_of_order to sessions."""
    counts = found.groupBy("key").agg(F.count_if(F.col("verdict") == "retransmission").alias("retransmissions"), F.count_if(F.col("verdict") == "buffered").alias("out_of_order"))
    return sessions.join(counts, "key", "left").fillna(0, ["retransmissions", "out_of_order"])


def with_states(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the worst state of both directions; sessions without segments are new."""
    states = found.groupBy("key").agg(F.first("session_state").alias("state"))
    return sessions.join(states, "key", "left").fillna("new", ["state"])


def idle_streams(found: DataFrame, now_ns: int, idle_ns: int = IDLE_NS) -> DataFrame:
    """Directions without a segment for longer than ``idle_ns`` when the capture ends."""
    return found.where(F.lit(now_ns) - F.col("last_ts") > idle_ns).select("key", "from_client", "state", F.lit("timeout").alias("reason"))


#: Sessions that are taken in, by their first segment's place in the capture.
MAX_SESSIONS = 100_000


def admitted(segments: DataFrame, most: int = MAX_SESSIONS) -> tuple[DataFrame, DataFrame]:
    """Segments of the first ``most`` sessions, and those that are refused, which belong to sessions that came when as many were there.

    First segments are found with partial minima; of them the ``most`` least are kept by a bounded sort in each task, and the two joins
    on the key move sessions as reassembly does. Nothing but those keys, a number that the parameter sets, is in one place.
    """
    firsts = segments.groupBy("key").agg(F.min("seq").alias("_first"))
    kept = firsts.orderBy("_first", "key").limit(most).select("key")
    return segments.join(kept, "key", "left_semi"), segments.join(kept, "key", "left_anti")


def capped_verdicts(segments: DataFrame, most: int = MAX_SESSIONS, limits: Limits | None = None, first_wins: bool = True) -> DataFrame:
    """:func:`verdicts` with a cap on sessions: a refused segment has the verdict ``dropped`` and no direction."""
    taken, refused = admitted(segments, most)
    gone = refused.select("key", "seq", "from_a", F.lit(None).cast("string").alias("direction"), F.lit("dropped").alias("verdict"), F.lit(0).cast("long").alias("amount"))
    return verdicts(taken, limits, first_wins).unionByName(gone)


def refused_counts(found: DataFrame) -> DataFrame:
    """(dropped_sessions, dropped_segments) of capped verdicts; the interface's counter goes up by one each refused segment."""
    gone = found.where(F.col("verdict") == "dropped").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return gone.agg(F.count(F.lit(1)).alias("dropped_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("dropped_segments"))


RECONSTRUCT_MOST = 262_144


def reconstruct(segments: DataFrame, key: str, from_client: bool = True, max_bytes: int = 65_536) -> DataFrame:
    """One direction of one TCP session: data (bounded), state and missing ranges. Only that session's segments are moved."""
    keep = min(max(max_bytes, 1), RECONSTRUCT_MOST)
    return streams(segments.where(F.col("key") == key), keep=keep).where(F.col("from_client") == from_client).withColumn("cut", F.col("ready_bytes") > F.length("data"))
