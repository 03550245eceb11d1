"""Stored tables as logs of deltas."""

import random
import threading

import pytest

from tidewire.operators.store import upsert
from tidewire.operators.table_log import TableLog

ROWS = "id string, n int, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("keep_first", [False, True])
def test_equal_to_upserts(spark, tmp_path, keep_first):
    r = random.Random(3)
    log, want = TableLog(spark, str(tmp_path / "t"), ["id"], keep_first, compact_at=3), None
    assert log.read() is None
    for k in range(6):
        new = spark.createDataFrame([(f"k{i}", k, None if r.random() < 0.2 else f"t{k}") for i in r.sample(range(12), 5)], ROWS)
        log.append(new)
        want = upsert(want, new, ["id"], keep_first)
        assert rows_of(log.read()) == rows_of(want)
    assert any("upto" in e for e in log.entries().values())


def test_a_write_costs_its_own_rows(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"), ["id"])
    log.append(spark.range(50_000).selectExpr("cast(id as string) id", "1 n", "'a' text"))
    before = {p for p in (tmp_path / "t" / "data").iterdir()}
    log.append(spark.createDataFrame([("7", 2, "b")], ROWS))
    (new,) = {p for p in (tmp_path / "t" / "data").iterdir()} - before
    assert spark.read.parquet(str(new)).count() == 1 and log.read().count() == 50_000
    assert log.read().where("id = '7'").first().n == 2


def test_two_writers(spark, tmp_path):
    def write(name):
        for k in range(4):
            TableLog(spark, str(tmp_path / "t"), ["id"]).append(spark.createDataFrame([(f"{name}{k}", k, name), ("both", k, name)], ROWS))

    both = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    log = TableLog(spark, str(tmp_path / "t"), ["id"])
    assert sorted(log.entries()) == list(range(1, 9))
    got = {r.id: (r.n, r.text) for r in log.read().collect()}
    assert set(got) == {f"{n}{k}" for n in "ab" for k in range(4)} | {"both"} and got["both"][0] == 3


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"), ["id"])
    for k in range(3):
        log.append(spark.createDataFrame([(f"k{k}", k, "x"), ("same", k, "x")], ROWS))
    merged, written = log._merged, log._written

    def meanwhile(rows):
        name = written(rows)
        log._written = written
        log.append(spark.createDataFrame([("late", 9, "y"), ("same", 9, "y")], ROWS))
        return name

    log._written = meanwhile
    assert log.compact() == 5
    assert merged is not None and rows_of(log.read()) == [("k0", 0, "x"), ("k1", 1, "x"), ("k2", 2, "x"), ("late", 9, "y"), ("same", 9, "y")]
    (tmp_path / "t" / "log" / f"{6:012d}.json").touch()  # a writer that died after it claimed a number
    log.append(spark.createDataFrame([("more", 1, "z")], ROWS))
    assert log.read().count() == 6 and 6 not in log.entries()
