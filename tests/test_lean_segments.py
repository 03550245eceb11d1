"""Verdicts and streams that keep no data move no data, and their tasks aren't merged by bytes."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import reassembly

SEGMENTS = "key string, seq long, from_a boolean, ts_ns long, tcp_seq long, syn boolean, ack boolean, fin boolean, rst boolean, data binary"


def made(spark, seed=1, n=2000):
    """Segments of 100 sessions with holes, overlaps, handshakes, missing flags and missing data."""
    r = random.Random(seed)
    flag = lambda p: r.choice([None, False]) if r.random() > p else True
    data = lambda: r.choice([None, b"", r.randbytes(5), r.randbytes(10), r.randbytes(40)])
    rows = [(f"s{r.randrange(100)}", k, r.random() < 0.6, r.randrange(10**6), (4294967290 + r.randrange(120)) & 0xFFFFFFFF, flag(0.05), flag(0.5), flag(0.02), flag(0.02), data()) for k in range(n)]
    return spark.createDataFrame(rows, SEGMENTS)


def plainly(frame, first_wins):
    """Verdicts by feeding each session's segments, with their data, one after the other."""
    out, clients, streams = [], {}, {}
    for r in sorted(frame.collect(), key=lambda r: r.seq):
        clients.setdefault(r.key, r.from_a)
        if r.syn and not r.ack:
            clients[r.key] = r.from_a
        up = r.from_a == clients[r.key]
        own = streams.setdefault((r.key, up), reassembly.Stream(first_wins=first_wins))
        out.append((r.key, r.seq, r.from_a, "client_to_server" if up else "server_to_client", *own.feed(r.tcp_seq, bytes(r.data or b""), r.ts_ns, bool(r.syn), bool(r.fin), bool(r.rst))))
    return sorted(out)


@pytest.mark.parametrize("first_wins", [True, False])
def test_lengths_give_what_data_give(spark, first_wins):
    frame = made(spark)
    assert sorted(map(tuple, reassembly.verdicts(frame, first_wins=first_wins).collect())) == plainly(frame, first_wins)
    bare, full = (sorted(map(repr, reassembly.streams(frame, first_wins=first_wins, keep=k).drop("data").collect())) for k in (0, None))
    assert bare == full


def test_data_that_nobody_keeps_stay_where_they_are(spark):
    for found in (reassembly.verdicts(made(spark)), reassembly.streams(made(spark))):
        moved = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].split("Project")[1]
        assert "length(data" in moved.splitlines()[0]


def test_small_partitions_are_not_merged(spark):
    tasks = lambda found: found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(reassembly.verdicts(made(spark))) > 1 and tasks(reassembly.streams(made(spark))) > 1
