"""Rules over a stream with a budget of groups: when too many are held, the one least recently touched is forgotten."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.rule_files import Rule
from ..operators.rules import matched_events
from .rules import ALERTS, WindowState

#: Windows of one rule that are held by default, over all shards.
MAX_GROUPS = 50_000
_WINDOW = "ts array<long>, x array<string>, b array<long>, until long, newest long"


class _Touched:
    """Groups by when they were last touched; entries of the heap that a later touch has overtaken are passed over."""

    def __init__(self, touched: dict[str, int]):
        self.at = touched
        self._heap = [(t, g) for g, t in touched.items()]
        heapq.heapify(self._heap)

    def touch(self, group: str, ts: int) -> None:
        self.at[group] = max(ts, self.at.get(group, ts))
        heapq.heappush(self._heap, (self.at[group], group))

    def pop_oldest(self) -> str:
        while True:
            t, group = heapq.heappop(self._heap)
            if self.at.get(group) == t:
                del self.at[group]
                return group


class BudgetProcessor(StatefulProcessor):
    """A shard's groups: a map of windows, when each was touched, and how many were forgotten."""

    def __init__(self, rule: Rule, most: int):
        self.rule, self.most = rule, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getMapState("windows", "grp string", _WINDOW)
        self.touched = handle.getMapState("touched", "grp string", "ts long")
        self.forgotten = handle.getValueState("forgotten", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["now_ns", "seq"], kind="stable")
        order = _Touched({g[0]: int(t[0]) for g, t in self.touched.iterator()})
        evicted = int(self.forgotten.get()[0]) if self.forgotten.exists() else 0
        held: dict[str, WindowState] = {}
        changed: set[str] = set()
        gone: set[str] = set()
        out = []
        for e in events.itertuples(index=False):
            group = e.grp
            if group not in order.at:
                if len(order.at) >= self.most:
                    victim = order.pop_oldest()
                    held.pop(victim, None)
                    changed.discard(victim)
                    gone.add(victim)
                    evicted += 1
                held[group] = WindowState(self.rule)
                gone.discard(group)
            elif group not in held:
                held[group] = WindowState(self.rule, *self.windows.getValue((group,)))
            order.touch(group, int(e.ts_ns))
            changed.add(group)
            window = held[group]
            value = window.feed(int(e.ts_ns), None if pd.isna(e.x) else str(e.x), int(e.bytes))
            if window.fires(value, int(e.now_ns)):
                out.append((group, int(e.seq), int(e.ts_ns), int(e.now_ns), value, evicted))
        for group in gone:
            if self.windows.containsKey((group,)):
                self.windows.removeKey((group,))
                self.touched.removeKey((group,))
        for group in changed:
            w = held[group]
            self.windows.updateValue((group,), (w.ts, w.x, w.b, w.until, w.newest))
            self.touched.updateValue((group,), (order.at[group],))
        self.forgotten.update((evicted,))
        yield pd.DataFrame(out, columns=["grp", "seq", "ts_ns", "now_ns", "value", "evicted"])

    def close(self) -> None:
        pass


def budgeted_alerts(events: DataFrame, rule: Rule, max_groups: int = MAX_GROUPS, shards: int = 64) -> DataFrame:
    """Alerts of a streaming event table whose groups have a budget: (grp, seq, ts_ns, now_ns, value, evicted).

    Groups are dealt over ``shards``, and each holds ``max_groups / shards`` of them; a new group in a full shard takes the place of the one with the
    least last time (of equal ones the first by name), whose window and cooldown are forgotten. ``evicted`` is how many its shard had forgotten by then. With
    one shard the budget is that of one process. A task holds the names and times of a shard's groups and the windows that a micro-batch touches.
    """
    own = matched_events(events, rule).withColumn("x", F.col("x").cast("string")).withColumn("shard", F.pmod(F.xxhash64("grp"), F.lit(shards)))
    most = max(1, max_groups // shards)
    return own.groupBy("shard").transformWithStateInPandas(statefulProcessor=BudgetProcessor(rule, most), outputStructType=ALERTS + ", evicted long", outputMode="Append", timeMode="None")
