"""Reassembly in stretches against the fold of whole sessions."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import elephants, reassembly
from tidewire.operators.reassembly import Limits

SEGMENTS = "key string, seq long, from_a boolean, ts_ns long, tcp_seq long, syn boolean, ack boolean, fin boolean, rst boolean, data binary"


def made(seed, n, wild=0.0):
    """Sessions with late, early, repeated and overlapping segments, handshakes in the middle, and numbers that wrap."""
    r = random.Random(seed)
    rows, at = [], {}
    for seq in range(n):
        key = f"s{min(r.randrange(12), r.randrange(12))}"
        from_a = r.random() < 0.6
        base = at.setdefault((key, from_a), [(1 << 32) - r.randrange(300), 0])
        step = r.choice([0, 0, 0, 0, -30, -7, 5, 20, 60]) if r.random() < 0.5 else 0
        size = r.choice([0, 5, 10, 10, 10, 40])
        offset = max(-20, base[1] + step)
        if r.random() < wild:
            offset += r.choice([1 << 31, -(1 << 31), 3 << 29])
        if step == 0:
            base[1] += size
        syn = r.random() < 0.01
        rows.append((key, seq, from_a, r.randrange(10**6), (base[0] + offset) & 0xFFFFFFFF, syn, syn and r.random() < 0.5, r.random() < 0.01, r.random() < 0.003, b"x" * (0 if syn and r.random() < 0.8 else size)))
    return rows


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("seed,stretch,limits,first_wins,wild", [
    (1, 64, Limits(), True, 0), (2, 7, Limits(), False, 0), (3, 100, Limits(200, 6), True, 0), (4, 33, Limits(10**6, 40), True, 0), (5, 50, Limits(), True, 0.01), (6, 1, Limits(), True, 0.002),
])
def test_equal_to_the_fold_of_whole_sessions(spark, seed, stretch, limits, first_wins, wild):
    frame = spark.createDataFrame(made(seed, 1500, wild), SEGMENTS)
    own = elephants.Reassembled(frame, limits, first_wins, stretch)
    assert same(own.verdicts(), reassembly.verdicts(frame, limits, first_wins))
    assert same(own.streams(), reassembly.streams(frame, limits, first_wins, 0))
    whole = own.whole.count()
    assert whole < frame.select("key").distinct().count() if not wild and limits == Limits() else True


def test_merged_sets_don_t_depend_on_their_order():
    r = random.Random(2)
    spans = [[a := r.randrange(200), a + r.randrange(1, 9), 1] for _ in range(60)]
    once = elephants.merged(spans, [])
    for _ in range(20):
        r.shuffle(spans)
        cut = r.randrange(60)
        assert elephants.merged(elephants.merged(spans[:cut], []), elephants.merged(spans[cut:], [])) == once
    assert sum(n for _, _, n in once) == 60 and all(a[1] < b[0] for a, b in zip(once, once[1:], strict=False))


def test_no_segments(spark):
    own = elephants.Reassembled(spark.createDataFrame([], SEGMENTS))
    assert own.verdicts().count() == 0 and own.streams().count() == 0


def test_one_session_of_a_million_segments(spark):
    n = 1_000_000
    k = F.col("id")
    at = F.floor(k / 5) * 40 + F.element_at(F.array(*map(F.lit, [0, 10, 30, 20, 30])), (k % 5 + 1).cast("int"))
    off = F.lit(False)
    frame = spark.range(n).repartition(8).select(
        F.lit("one").alias("key"), k.alias("seq"), F.lit(True).alias("from_a"), k.alias("ts_ns"), ((F.lit(4294967290) + at) % (1 << 32)).alias("tcp_seq"),
        off.alias("syn"), off.alias("ack"), off.alias("fin"), off.alias("rst"), F.lit(b"0123456789").alias("data"),
    )
    own = elephants.Reassembled(frame)
    found = own.verdicts()
    assert own.whole.count() == 0
    counts = {(r[0], r[1]): r[2] for r in found.groupBy((F.col("seq") % 5).alias("k"), "verdict").count().collect()}
    assert counts == {(0, "in_order"): n // 5, (1, "in_order"): n // 5, (2, "buffered"): n // 5, (3, "in_order"): n // 5, (4, "retransmission"): n // 5}
    (row,) = own.streams().collect()
    assert (row.state, row.ready_bytes, row.missing) == ("active", n // 5 * 40, [])
    spread = frame.select(F.shiftright("seq", 16).alias("stretch")).distinct().count()
    assert spread >= 8
