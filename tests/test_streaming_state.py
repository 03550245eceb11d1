"""State of streams: reassembly with timers, flush of idle groups, a budget of groups; each against the batch or a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_elephants import SEGMENTS
from tidewire.operators import reassembly, rules
from tidewire.operators.reassembly import Limits
from tidewire.operators.rule_files import load_rules
from tidewire.streaming.budget import budgeted_alerts
from tidewire.streaming.reassembly import stream_reassembly
from tidewire.streaming.rules import WindowState, stream_alerts
from tests.test_rules import events

MS = 1_000_000
T0 = 1_700_000_000_000 * MS
SYN_BURST = {r.id: r for r in load_rules()}["NET-TCP-SYN-BURST-001"]


def streamed(spark, tmp_path, frame, by, files, query, name):
    """All rows that ``query`` gives of ``frame``, read file by file in the order of ``by``."""
    cuts = frame.select(F.min(by), F.max(by)).first()
    width = (cuts[1] - cuts[0]) // files + 1
    for k in range(files):
        frame.where((F.col(by) >= cuts[0] + k * width) & (F.col(by) < cuts[0] + (k + 1) * width)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = query(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).collect()


def made(seed, n):
    """Half the sessions end early; segments come late, early, twice and across the wrap of numbers."""
    r = random.Random(seed)
    rows, at = [], {}
    for seq in range(n):
        key = f"s{r.randrange(8) if seq < n // 3 else r.randrange(4)}"
        from_a = r.random() < 0.6
        base = at.setdefault((key, from_a), [(1 << 32) - r.randrange(300), 0])
        step, size = r.choice([0, 0, 0, -10, 10, 30]), r.choice([0, 5, 10, 10])
        offset = max(-20, base[1] + step)
        base[1] += size if step == 0 else 0
        rows.append((key, seq, from_a, T0 + seq * MS, (base[0] + offset) & 0xFFFFFFFF, r.random() < 0.01, False, r.random() < 0.01, False, b"x" * size))
    return rows


@pytest.mark.parametrize("limits", [Limits(), Limits(60, 3)])
def test_stream_reassembly_equals_batch(spark, tmp_path, limits):
    n, idle = 900, 250 * MS
    frame = spark.createDataFrame(made(3, n), SEGMENTS)
    got = streamed(spark, tmp_path, frame, "seq", 4, lambda s: stream_reassembly(s, limits, idle_ns=idle), f"reassembly_{limits.max_segments}")
    want = sorted(map(tuple, reassembly.verdicts(frame, limits).collect()))
    assert sorted((r.key, r.seq, r.from_a, r.direction, r.verdict, r.amount) for r in got if r.kind == "verdict") == want
    ends = reassembly.streams(frame, limits).cache()
    idle_ones = {(r.key, r.from_client) for r in reassembly.idle_streams(ends, T0 + (n - 1) * MS, idle).collect()}
    whole = {(r.key, r.from_client): (r.state, r.ready_bytes, r.last_ts) for r in ends.collect()}
    timeouts = [r for r in got if r.kind == "timeout"]
    assert {(r.key, r.from_client): (r.state, r.ready_bytes, r.last_ts) for r in timeouts} == {k: whole[k] for k in idle_ones}
    assert len(timeouts) == len(idle_ones) >= 6


def test_flush_of_idle_groups_equals_the_batch(spark, tmp_path):
    r = random.Random(6)
    rows = sorted(((T0 + r.randrange(40_000) * MS, {"src": f"10.0.0.{r.randrange(3)}"}) for _ in range(2500)), key=lambda x: x[0])
    rows.append((T0 + 10**7 * MS, {"src": "10.0.0.99"}))  # so much later that all others end
    frame = events(spark, rows)
    want = sorted(tuple(x) for x in rules.evaluate(frame, SYN_BURST, flush=True).select("grp", "seq", "ts_ns", "now_ns", "value").collect())
    without = rules.evaluate(frame, SYN_BURST).count()
    got = streamed(spark, tmp_path, frame.withColumn("f", F.least(F.col("seq"), F.lit(2501))), "seq", 3, lambda s: stream_alerts(s.drop("f"), SYN_BURST, flush_idle_ns=100_000 * MS), "flushed")
    assert sorted(tuple(x) for x in got) == want and len(want) > without > 0


def plain_budget(rows, rule, most):
    held, touched, out, evicted = {}, {}, [], 0
    for grp, seq, ts, now, size in rows:
        if grp not in held:
            if len(held) >= most:
                victim = min(held, key=lambda g: (touched[g], g))
                del held[victim], touched[victim]
                evicted += 1
            held[grp] = WindowState(rule)
        touched[grp] = max(ts, touched.get(grp, ts))
        value = held[grp].feed(ts, None, size)
        if held[grp].fires(value, now):
            out.append((grp, seq, ts, now, value, evicted))
    return out


def test_budget_of_groups_equals_a_plain_fold(spark, tmp_path):
    r = random.Random(7)
    rows = [(k * 2 * MS, {"src": f"10.0.{0 if r.random() < 0.5 else r.randrange(1, 20)}.{r.randrange(25)}"}) for k in range(6000)]
    frame = events(spark, rows)
    own = [(x.grp, x.seq, x.ts_ns, x.now_ns, x.bytes) for x in rules.matched_events(frame, SYN_BURST).orderBy("now_ns", "seq").collect()]
    want = plain_budget(own, SYN_BURST, 100)
    got = streamed(spark, tmp_path, frame, "seq", 3, lambda s: budgeted_alerts(s, SYN_BURST, 100, 1), "budgeted")
    assert sorted(tuple(x) for x in got) == sorted(want) and want and want[-1][-1] > 100
