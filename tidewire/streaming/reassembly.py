"""TCP reassembly over a stream: each session's directions wait in the state store, and event-time timers end those that are idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reassembly import COLUMNS, IDLE_NS, Limits, Stream

FOUND = "kind string, key string, seq long, from_a boolean, direction string, verdict string, amount long, from_client boolean, state string, ready_bytes long, last_ts long"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]
#: The directions of a session side by side, and what waits in them.
_STATE = "client boolean, timer long, up array<boolean>, base array<long>, done array<long>, held array<long>, marks array<int>, last array<long>, of array<int>, at array<long>, data array<binary>"
MS = 1_000_000


class SessionProcessor(StatefulProcessor):
    """Verdicts as segments come, and a ``timeout`` row for each direction without a segment for longer than ``idle_ns``.

    The segments of a session must come in file order from batch to batch; within one they are sorted. After a timeout the direction is
    forgotten, so a segment that comes later begins it anew.
    """

    def __init__(self, limits: Limits, first_wins: bool, idle_ns: int):
        self.limits, self.first_wins, self.idle_ns = limits, first_wins, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("session", _STATE)

    def _load(self) -> tuple[bool | None, int | None, dict[bool, Stream]]:
        if not self.held.exists():
            return None, None, {}
        client, timer, ups, bases, dones, helds, marks, lasts, of, at, data = self.held.get()
        streams = {}
        for k, up in enumerate(ups):
            own = streams[bool(up)] = Stream(self.limits, self.first_wins, 0)
            own.base, own.done, own.ready_total, own.held, own.last_ts = None if bases[k] < 0 else int(bases[k]), int(dones[k]), int(dones[k]), int(helds[k]), int(lasts[k])
            own.overflow, own.fin, own.rst = bool(marks[k] & 1), bool(marks[k] & 2), bool(marks[k] & 4)
            own.waiting = [(int(at[i]), bytes(data[i])) for i in range(len(of)) if of[i] == k]
        return bool(client), timer, streams

    def _store(self, client: bool, old: int | None, streams: dict[bool, Stream]) -> None:
        """Keeps the session, with a timer for the direction that is idle first."""
        if not streams:
            self.held.clear()
            return
        timer = (min(s.last_ts for s in streams.values()) + self.idle_ns) // MS + 1
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        own = list(streams.items())
        waiting = [(k, at, data) for k, (_, s) in enumerate(own) for at, data in s.waiting]
        marks = [s.overflow | s.fin << 1 | s.rst << 2 for _, s in own]
        self.held.update((
            client, timer, [up for up, _ in own], [-1 if s.base is None else s.base for _, s in own], [s.done for _, s in own], [s.held for _, s in own], marks, [s.last_ts for _, s in own],
            [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting],
        ))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        client, timer, streams = self._load()
        out = []
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):  # the rows of one session in one micro-batch
            from_a = bool(r.from_a)
            client = from_a if client is None or (r.syn and not r.ack) else client
            up = from_a == client
            stream = streams.get(up) or streams.setdefault(up, Stream(self.limits, self.first_wins, 0))
            verdict, amount = stream.feed(int(r.tcp_seq), bytes(r.data), int(r.ts_ns), bool(r.syn), bool(r.fin), bool(r.rst))
            out.append(("verdict", key[0], int(r.seq), from_a, "client_to_server" if up else "server_to_client", verdict, amount, None, None, None, None))
        self._store(client, timer, streams)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        client, timer, streams = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs() * MS
        idle = {up: s for up, s in streams.items() if now - s.last_ts > self.idle_ns}
        out = [("timeout", key[0], None, None, None, None, None, up, s.state(), s.ready_total, s.last_ts) for up, s in sorted(idle.items(), reverse=True)]
        left = {up: s for up, s in streams.items() if up not in idle}
        self._store(client, None, left)  # the timer that expired is gone
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def stream_reassembly(segments: DataFrame, limits: Limits | None = None, first_wins: bool = True, idle_ns: int = IDLE_NS, lateness: str = "0 seconds") -> DataFrame:
    """Verdicts (kind ``verdict``) and idle directions (``timeout``) of a stream of segments, in append mode.

    Times out by the watermark of ``ts_ns``, to the millisecond; segments that are later than ``lateness`` are left out. A session's state has
    no more than ``limits`` allow to wait. Needs the RocksDB state store.
    """
    own = segments.select(*COLUMNS).withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("event_time", lateness)
    processor = SessionProcessor(limits or Limits(), first_wins, idle_ns)
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=FOUND, outputMode="Append", timeMode="EventTime")
