"""Rules over a stream: the same sliding windows, with state for each group that is bounded by the window."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rule_files import Rule
from ..operators.rules import matched_events

ALERTS = "grp string, seq long, ts_ns long, now_ns long, value double"
#: As in the reference semantics, a group's window holds this many events at most; beyond, the older half goes and alerts are marked.
STRICT_EVENTS = 4096
COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: abs(a - b) < 2.220446049250313e-16, "neq": lambda a, b: abs(a - b) >= 2.220446049250313e-16}


class WindowState:
    """A group's window and cooldown. Events are fed in order; late ones stay if the front hasn't passed them."""

    def __init__(self, rule: Rule, ts=(), x=(), b=(), until: int | None = None, newest: int | None = None, strict: bool = False):
        self.rule, self.strict = rule, strict
        self.ts, self.x, self.b, self.until, self.newest = list(ts), list(x), list(b), until, newest
        self.degraded = False
        self.counts = Counter(self.x)
        self.total = sum(self.b)
        self.hits = sum(self._hit(v) for v in self.x)

    def _hit(self, v) -> bool:
        return v is not None and self.rule.field_gt is not None and float(v) > self.rule.field_gt

    def _drop(self, n: int) -> None:
        for k in range(n):
            self.counts[self.x[k]] -= 1
            if not self.counts[self.x[k]]:
                del self.counts[self.x[k]]
            self.total -= self.b[k]
            self.hits -= self._hit(self.x[k])
        del self.ts[:n], self.x[:n], self.b[:n]

    def feed(self, ts: int, x, size: int) -> float:
        self.newest = ts if self.newest is None else max(self.newest, ts)
        self.ts.append(ts)
        self.x.append(x)
        self.b.append(size)
        self.counts[x] += 1
        self.total += size
        self.hits += self._hit(x)
        k = 0
        while k < len(self.ts) and self.ts[k] < self.newest - self.rule.window_ns:
            k += 1
        if k:
            self._drop(k)
        if self.strict and len(self.ts) > STRICT_EVENTS:
            self._drop(len(self.ts) // 2)
            self.degraded = True
        return self.value()

    def value(self) -> float:
        m = self.rule.metric
        return float(len(self.counts) if m == "distinct_count" else self.total if m == "sum_bytes" else self.hits / max(len(self.ts), 1) if m == "ratio" else len(self.ts))

    def fires(self, value: float, now: int) -> bool:
        if COMPARE[self.rule.operator](value, self.rule.value) and (self.until is None or now >= self.until):
            self.until = now + self.rule.cooldown_ns
            return True
        return False


class RuleProcessor(StatefulProcessor):
    def __init__(self, rule: Rule, ttl_ms: int | None = None, strict: bool = False):
        self.rule, self.ttl_ms, self.strict = rule, ttl_ms, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "ts array<long>, x array<string>, b array<long>, until long, newest long, degraded boolean", **({"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        window = WindowState(self.rule, *(held[:5] if held else ()), strict=self.strict)
        window.degraded = bool(held and held[5])
        events = pd.concat(list(rows)).sort_values(["ts_ns", "seq"], kind="stable")  # the rows of one key in one micro-batch
        out = []
        for e in events.itertuples(index=False):
            value = window.feed(int(e.ts_ns), None if pd.isna(e.x) else str(e.x), int(e.bytes))
            if window.fires(value, int(e.now_ns)):
                out.append((key[0], int(e.seq), int(e.ts_ns), int(e.now_ns), value, window.degraded))
        self.state.update((window.ts, window.x, window.b, window.until, window.newest, window.degraded))
        columns = ["grp", "seq", "ts_ns", "now_ns", "value", "degraded"]
        yield pd.DataFrame(out, columns=columns)[columns if self.strict else columns[:-1]]

    def close(self) -> None:
        pass


class FlushProcessor(RuleProcessor):
    """Besides, a group that is idle for ``idle_ns`` by the watermark ends: its last window is looked at once more, and its state goes."""

    def __init__(self, rule: Rule, idle_ns: int, strict: bool = False):
        super().__init__(rule, None, strict)
        self.idle_ns = idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, ts_ns long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = list(rows)
        yield from super().handleInputRows(key, iter(held), timer_values)
        seq, ts, old = self.last.get() if self.last.exists() else (None, None, None)
        for batch in held:
            last = batch.sort_values(["ts_ns", "seq"], kind="stable").iloc[-1]
            if ts is None or (int(last.ts_ns), int(last.seq)) > (ts, seq):
                seq, ts = int(last.seq), int(last.ts_ns)
        timer = (ts + self.idle_ns) // 1_000_000 + 1
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        self.last.update((seq, ts, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        columns = ["grp", "seq", "ts_ns", "now_ns", "value", "degraded"][: None if self.strict else -1]
        held, (seq, ts, _) = self.state.get(), self.last.get()
        window = WindowState(self.rule, *held[:5], strict=self.strict)
        window.degraded = bool(held[5])
        now = timerValues.getCurrentWatermarkInMs() * 1_000_000
        value = window.value()
        out = [(key[0], seq, ts, now, value, window.degraded)] if window.ts and window.fires(value, now) else []
        self.state.clear()
        self.last.clear()
        yield pd.DataFrame([r[: len(columns)] for r in out], columns=columns)


def stream_alerts(events: DataFrame, rule: Rule, ttl_ms: int | None = None, strict: bool = False, flush_idle_ns: int | None = None) -> DataFrame:
    """Alerts of a streaming event table in append mode. The match filters before rows move to their group's state.

    Needs the RocksDB state store. ``ttl_ms`` forgets groups that are idle for so long. ``strict`` holds a window to
    4,096 events; alerts of a group that had more are marked in a further column, ``degraded``.

    ``flush_idle_ns`` ends groups: one without an event for so long, by the watermark of its rule's events, has its last window looked at once more with
    the watermark as now, as :func:`~..operators.rules.evaluate` does with ``flush`` when a capture ends, and is forgotten. To end all, let an event follow
    that is so much later. It takes the place of ``ttl_ms``.
    """
    own = matched_events(events, rule).withColumn("x", F.col("x").cast("string"))
    if flush_idle_ns is not None:
        timed = own.withColumn("event_time", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("event_time", "0 seconds")
        return timed.groupBy("grp").transformWithStateInPandas(statefulProcessor=FlushProcessor(rule, flush_idle_ns, strict), outputStructType=ALERTS + (", degraded boolean" if strict else ""), outputMode="Append", timeMode="EventTime")
    return own.groupBy("grp").transformWithStateInPandas(statefulProcessor=RuleProcessor(rule, ttl_ms, strict), outputStructType=ALERTS + (", degraded boolean" if strict else ""), outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
