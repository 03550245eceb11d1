"""Reassembly without a session in one task: sessions are cut into stretches of packets.

What arrived of a direction is a set of byte intervals, and sets merge in any order. (1) Each stretch of a session folds its segments
into intervals relative to its first one (:func:`_summary`). (2) A session's summaries, a row a stretch, pass in order and are merged into the
state that each stretch begins with (:class:`_Direction`). (3) Each stretch is folded again from that state by the same
:class:`~.reassembly.Stream` that folds whole sessions, so verdicts are the same. What the sets can't tell, which is data that a full budget dropped and
segments more than half the number space apart, is noticed in (2) and (3), and such a session is folded as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from . import reassembly
from .reassembly import Limits, Stream, worst

#: Packets of a capture whose segments of one session are folded by one task.
STRETCH = 1 << 16


def _near(seq: int, base: int) -> int:
    """How far a sequence number is from another, within half the number space."""
    return ((seq - base + (1 << 31)) & 0xFFFFFFFF) - (1 << 31)


Spans = list[list[int]]


def merged(a: Spans, b: Spans) -> Spans:
    """The union of two sets of [start, end, segments], intervals that touch become one."""
    out: Spans = []
    for start, end, n in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = [out[-1][0], max(out[-1][1], end), out[-1][2] + n]
        else:
            out.append([start, end, n])
    return out


@dataclass
class _Side:
    """What one sender adds while the client stays the same: intervals from the first data on, and marks."""

    syn: int | None = None
    first: int | None = None
    last: int | None = None
    rel: int = 0
    spans: Spans = field(default_factory=list)
    fin: bool = False
    rst: bool = False
    last_ts: int = 0

    def add(self, seq: int, n: int, ts: int, syn: bool, fin: bool, rst: bool) -> None:
        self.last_ts, self.fin, self.rst = max(self.last_ts, ts), self.fin or fin, self.rst or rst
        if not n:
            if syn and self.syn is None and self.first is None:
                self.syn = (seq + 1) & 0xFFFFFFFF
            return
        if self.first is None:
            self.first, self.last = seq, seq
        self.rel += _near(seq, self.last)
        self.last = seq
        self.spans.append([self.rel, self.rel + n, 1])
        if len(self.spans) > 4096:
            self.spans = merged(self.spans, [])


@dataclass
class _Direction:
    """A direction between two stretches."""

    base: int | None = None
    last: int | None = None
    at: int = 0
    spans: Spans = field(default_factory=list)
    fin: bool = False
    rst: bool = False
    last_ts: int = 0

    def take(self, side: _Side) -> None:
        self.last_ts, self.fin, self.rst = max(self.last_ts, side.last_ts), self.fin or side.fin, self.rst or side.rst
        if self.base is None:
            self.base = side.syn if side.syn is not None else side.first
        if side.first is None:
            return
        begin = _near(side.first, self.base) if self.last is None else self.at + _near(side.first, self.last)
        self.last, self.at = side.last, begin + side.rel
        own = [[max(0, a + begin), b + begin, n] for a, b, n in side.spans if b + begin > 0]
        self.spans = merged(self.spans, own)

    @property
    def done(self) -> int:
        return self.spans[0][1] if self.spans and self.spans[0][0] == 0 else 0

    def waiting(self) -> Spans:
        return self.spans[1:] if self.done else self.spans

    def pieces(self) -> int:
        """No more pieces than this wait: n segments fill at most 2 n - 1 holes between one another."""
        return sum(2 * n - 1 for _, _, n in self.waiting())

    def within(self, limits: Limits) -> bool:
        return self.pieces() <= limits.max_segments and sum(b - a for a, b, _ in self.waiting()) <= limits.max_bytes

    def stream(self, limits: Limits, first_wins: bool) -> Stream:
        own = Stream(limits, first_wins, 0)
        own.base, own.done, own.ready_total = self.base, self.done, self.done
        own.waiting = [(a, bytes(b - a)) for a, b, _ in self.waiting()]
        own.held = sum(b - a for a, b, _ in self.waiting())
        own.fin, own.rst, own.last_ts = self.fin, self.rst, self.last_ts
        return own


class _Summary:
    """A stretch of a session: runs in which the client stays the same; of the first one it isn't known."""

    def __init__(self, first_from_a: bool):
        self.first_from_a = first_from_a
        self.runs: list[tuple[bool | None, dict[bool, _Side]]] = [(None, {})]

    def add(self, from_a: bool, ts: int, seq: int, syn: bool, ack: bool, fin: bool, rst: bool, n: int) -> None:
        if syn and not ack and self.runs[-1][0] != from_a:
            self.runs.append((from_a, {}))
        sides = self.runs[-1][1]
        side = sides.get(from_a) or sides.setdefault(from_a, _Side())
        side.add(seq, n, ts, syn, fin, rst)

    def to_json(self) -> str:
        own = [[client, [[a, vars(s) | {"spans": merged(s.spans, [])}] for a, s in sides.items()]] for client, sides in self.runs]
        return json.dumps([self.first_from_a, own])


def _told(client: bool | None, streams: dict[bool, _Direction]) -> str:
    return json.dumps([client, [[up, vars(d)] for up, d in streams.items()]])


def _heard(text: str) -> tuple[bool | None, dict[bool, _Direction]]:
    client, streams = json.loads(text)
    return client, {up: _Direction(**d) for up, d in streams}


_SEGMENT = ["key", "stretch", "from_a", "ts_ns", "tcp_seq", "syn", "ack", "fin", "rst", "n"]


def _summarized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now, own = None, None
    for batch in batches:
        for key, stretch, from_a, ts, seq, syn, ack, fin, rst, n in zip(*(batch.column(c).to_pylist() for c in _SEGMENT), strict=True):
            if own is None or (key, stretch) != now:
                if own is not None:
                    yield (*now, own.to_json())
                now, own = (key, stretch), _Summary(from_a)
            own.add(from_a, ts, seq, syn, ack, fin, rst, n)
    if own is not None:
        yield (*now, own.to_json())


#: What a row of the states is: a state that a stretch begins with, the state at a session's end, a session that must be folded as a whole.
_BEGINS, _ENDS, _WHOLE = range(3)


def _composed(limits: Limits):
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, whole, client = None, False, None
        streams: dict[bool, _Direction] = {}

        def end() -> Iterator[tuple]:
            if now is not None and not whole:
                yield _ENDS, now, None, _told(client, streams)

        for batch in batches:
            for key, stretch, text in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "summary")), strict=True):
                if key != now:
                    yield from end()
                    now, whole, client, streams = key, False, None, {}
                if whole:
                    continue
                first_from_a, runs = json.loads(text)
                yield _BEGINS, key, stretch, _told(client, streams)
                client = first_from_a if client is None else client
                for own, sides in runs:
                    client = client if own is None else own
                    for from_a, side in sides:
                        up = from_a == client
                        (streams.get(up) or streams.setdefault(up, _Direction())).take(_Side(**side))
                if not all(d.within(limits) for d in streams.values()):
                    whole = True
                    yield _WHOLE, key, None, None
        yield from end()

    return compose


_VERDICT, _AGAIN = range(2)


def _folded(limits: Limits, first_wins: bool):
    """Verdicts of each stretch from the state that it begins with; a row that says so if that state can't be relied on."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, client, streams, again = None, None, {}, False
        places: dict[bool, list] = {}  # the last number and its offset as the summaries have them, and pieces that may wait unseen
        for batch in batches:
            columns = ("key", "stretch", "state", "seq", "from_a", "ts_ns", "tcp_seq", "syn", "ack", "fin", "rst", "data")
            for key, stretch, state, seq, from_a, ts, tcp_seq, syn, ack, fin, rst, data in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if state is not None:
                    now, again = (key, stretch), False
                    client, begins = _heard(state)
                    streams = {up: d.stream(limits, first_wins) for up, d in begins.items()}
                    places = {up: [d.last, d.at, d.pieces() - len(d.waiting())] for up, d in begins.items()}
                    continue
                if again or (key, stretch) != now:  # without a state the session is folded as a whole
                    continue
                client = from_a if client is None else client
                if syn and not ack:
                    client = from_a
                up = from_a == client
                own = streams.get(up) or streams.setdefault(up, Stream(limits, first_wins, 0))
                place = places.setdefault(up, [None, 0, 0])
                if data:
                    base = tcp_seq if own.base is None else own.base
                    place[1] = _near(tcp_seq, base) if place[0] is None else place[1] + _near(tcp_seq, place[0])
                    place[0] = tcp_seq
                    again = place[1] != own.done + _near(tcp_seq, (base + own.done) & 0xFFFFFFFF)
                verdict, amount = own.feed(tcp_seq, data, ts, syn, fin, rst)
                again = again or own.overflow or len(own.waiting) + place[2] > limits.max_segments
                if again:
                    yield _AGAIN, key, None, None, None, None, None
                else:
                    yield _VERDICT, key, seq, from_a, "client_to_server" if up else "server_to_client", verdict, amount

    return fold


def _stream_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("state").to_pylist(), strict=True):
            _, streams = _heard(text)
            own = {up: d.stream(Limits(), True) for up, d in streams.items()}
            both = worst(*(s.state() for s in own.values()))
            for up, s in sorted(own.items(), reverse=True):
                yield key, up, s.state(), both, s.ready_total, s.last_ts, [{"start": a, "end": b} for a, b in s.missing()], b""


_SUMMARIES = pa.schema([("key", pa.string()), ("stretch", pa.int64()), ("summary", pa.string())])
_STATES = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("stretch", pa.int64()), ("state", pa.string())])
_FOLDED = pa.schema([("kind", pa.int32()), *reassembly._VERDICTS])


class Reassembled:
    """Sessions of ``segments`` (as of :func:`~.reassembly.tcp_segments`), whatever their length.

    :meth:`verdicts` and :meth:`streams` equal those of :mod:`.reassembly` (there with ``keep=0``). A session's segments are spread by
    stretches of ``stretch`` packets; a row a stretch passes the task that composes them. Steps are stored in the shared folder.
    """

    def __init__(self, segments: DataFrame, limits: Limits | None = None, first_wins: bool = True, stretch: int = STRETCH):
        self._segments, self._limits, self._first_wins = segments.select(*reassembly.COLUMNS), limits or Limits(), first_wins
        self._stretch: Column = F.floor(F.col("seq") / stretch).cast("long") if stretch & stretch - 1 else F.shiftright("seq", stretch.bit_length() - 1).cast("long")
        cut = self._segments.withColumn("stretch", self._stretch)
        narrow = cut.select(*_SEGMENT[:-1], F.length("data").alias("n"), "seq")
        parts = narrow.repartition("key", "stretch").sortWithinPartitions("key", "stretch", "seq").drop("seq")
        summaries = parts.mapInArrow(lambda b: reassembly._batches(_summarized(b), _SUMMARIES, lambda r: len(r[-1])), "key string, stretch long, summary string")
        ordered = summaries.repartition("key").sortWithinPartitions("key", "stretch")
        composed = _composed(self._limits)
        self._states = materialize(ordered.mapInArrow(lambda b: reassembly._batches(composed(b), _STATES, lambda r: len(r[-1] or "")), "kind int, key string, stretch long, state string"), "states")
        begins = self._states.where(F.col("kind") == _BEGINS).select("key", "stretch", "state")
        rows = cut.withColumn("state", F.lit(None).cast("string")).unionByName(begins, allowMissingColumns=True)
        dealt = rows.repartition("key", "stretch").sortWithinPartitions("key", "stretch", F.col("state").isNull(), "seq")
        fold = _folded(self._limits, first_wins)
        self._folds = materialize(dealt.mapInArrow(lambda b: reassembly._batches(fold(b), _FOLDED), "kind int, " + reassembly.VERDICTS), "folds")
        early = self._states.where(F.col("kind") == _WHOLE).select("key")
        self.whole = early.unionByName(self._folds.where(F.col("kind") == _AGAIN).select("key")).distinct()

    def _else_whole(self, found: DataFrame, folded) -> DataFrame:
        whole = self.whole.select(F.col("key").alias("_whole"))
        kept = found.join(whole, F.col("key") == F.col("_whole"), "left_anti")
        again = self._segments.join(whole, F.col("key") == F.col("_whole"), "left_semi")
        return kept.unionByName(folded(again))

    def verdicts(self) -> DataFrame:
        found = self._folds.where(F.col("kind") == _VERDICT).drop("kind")
        return self._else_whole(found, lambda rows: reassembly.verdicts(rows, self._limits, self._first_wins))

    def streams(self) -> DataFrame:
        ends = self._states.where(F.col("kind") == _ENDS).select("key", "state")
        found = ends.mapInArrow(lambda b: reassembly._batches(_stream_rows(b), reassembly._STREAMS), reassembly.STREAMS)
        return self._else_whole(found, lambda rows: reassembly.streams(rows, self._limits, self._first_wins, 0))
