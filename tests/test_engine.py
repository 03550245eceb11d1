import pytest
from pyspark.sql import functions as F

from tidewire.functions import scalars as X
from tidewire.operators import reassembly, store
from tidewire.operators.reassembly import Limits, Stream
from tidewire.operators.rule_files import Rule
from tidewire.plans.engine import Engine, InvalidArgument
from tidewire.plans.report import render
from tidewire.sources import synth
from tidewire.streaming import windows
from tidewire.streaming.rules import stream_alerts

D = b"x" * 100


def fed(*segments, **k):
    s = Stream(**k)
    return s, [s.feed(*x) if isinstance(x, tuple) else s.feed(**x) for x in segments]


def test_verdicts():
    s, v = fed((1000, D), (1000, D))
    assert [x[0] for x in v] == ["in_order", "retransmission"] and s.ready_total == 100
    s, v = fed((1000, D), (1200, D), (1100, D))
    assert v == [("in_order", 0), ("buffered", 100), ("in_order", 0)] and s.ready_total == 300
    s, v = fed((1000, D), (1200, D))
    assert s.missing() == [(1100, 1200)] and s.state() == "incomplete"
    s, v = fed((1000, b"a" * 100), (1050, b"b" * 100))
    assert v[1] == ("partial_overlap", 50) and bytes(s.ready) == b"a" * 100 + b"b" * 50
    s, v = fed((9000, b""), (1000, D))
    assert [x[0] for x in v] == ["in_order"] * 2 and not s.missing()
    s, v = fed({"seq": 1000, "data": b"", "syn": True}, (1001, b"y" * 50))
    assert not s.missing() and s.ready_total == 50
    s, v = fed((0xFFFFFFF0, D), (0x54, D))
    assert v[1][0] == "in_order" and s.ready_total == 200


def test_overlaps_and_budgets():
    s, _ = fed((0, b"a"), (10, b"b" * 10), (5, b"c" * 20))
    assert b"".join(d for _, d in s.waiting) == b"c" * 5 + b"b" * 10 + b"c" * 5
    s, _ = fed((0, b"a"), (10, b"b" * 10), (5, b"c" * 20), first_wins=False)
    assert b"".join(d for _, d in s.waiting) == b"c" * 20
    s, _ = fed((0, b"a"), (10, b"b" * 10), (30, b"c" * 10), limits=Limits(max_bytes=15))
    assert s.state() == "buffer_overflow"
    s, _ = fed({"seq": 0, "data": b"a", "fin": True})
    assert s.state() == "half_closed"
    s, _ = fed({"seq": 0, "data": b"a", "rst": True})
    assert s.state() == "closed" and reassembly.worst("active", "incomplete", "closed") == "incomplete"


def http_flow():
    c, s = ("10.0.0.1", 40000), ("10.0.0.2", 80)
    up = lambda seq, flags, data=b"": synth.ethernet(synth.ipv4(synth.tcp(c[1], s[1], seq, 0, flags, data), c[0], s[0], 6))
    down = lambda seq, flags, data=b"": synth.ethernet(synth.ipv4(synth.tcp(s[1], c[1], seq, 0, flags, data), s[0], c[0], 6))
    ask, answer = b"GET / HTTP/1.1\r\nHost: a\r\nAuthorization: Basic abc\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\nhello"
    frames = [up(1000, 2), down(5000, 18), up(1001, 16), up(1001, 24, ask), up(1001, 24, ask), down(5001, 24, answer), up(1001 + len(ask), 17), down(5001 + len(answer), 17), b"\x00" * 5]
    return [(1_700_000_000_000_000_000 + k * 1_000_000, f) for k, f in enumerate(frames)], ask, answer


@pytest.fixture(scope="module")
def task(spark, tmp_path_factory):
    frames, _, _ = http_flow()
    path = tmp_path_factory.mktemp("captures") / "flow.pcapng"
    path.write_bytes(synth.block_file(frames))
    return Engine(spark).analyze(str(path), "task_1")


def test_answers(task):
    _, ask, answer = http_flow()
    got = task.summary()["content"]
    assert (got["packets"], got["sessions"], got["tcp"], got["decode_errors"]) == (9, 1, 8, 1) and got["protocols"] == {"tcp": 8}
    (row,) = task.conversations()["content"]["rows"]
    assert (row["id"], row["client_ip"], row["basis"], row["state"], row["retransmissions"], row["syn"]) == ("S-000001", "10.0.0.1", "syn_first", "half_closed", 1, 1)
    stream = task.reconstruct_stream("S-000001")["content"]
    assert stream["bytes"] == len(ask) and "[redacted]" in stream["preview"] and "abc" not in stream["preview"] and stream["content_type"] == "http_request"
    assert task.reconstruct_stream("S-000001", False)["content"]["bytes"] == len(answer)
    seen = task.inspect_packets([5, 3, 3])
    assert [r["packet_index"] for r in seen["content"]["rows"]] == [5, 3, 3] and seen["redactions"] == 2
    assert len(task.filter_packets(tcp_flags=("SYN",))["content"]["rows"]) == 2
    assert task.protocol_stats("http")["content"]["rows"][0]["packets"] == 3
    assert task.alerts()["content"]["rows"] == []
    for call in (lambda: task.protocol_stats("nope"), lambda: task.inspect_packets([]), lambda: task.reconstruct_stream("S-9"), lambda: task.history("nope")):
        with pytest.raises(InvalidArgument):
            call()


def test_findings_and_report(task, spark, tmp_path):
    call = task.conversations()
    cite = {"_id": call["_id"], "method": "get_conversations", "ref_id": "S-000001"}
    bytes_ = call["content"]["_numbers"]["S-000001.bytes"]
    good = {"title": "t", "severity": "low", "basis": "b", "summary": "s", "evidence": [cite], "claims": [{"_id": call["_id"], "field": "S-000001.bytes", "value": float(bytes_)}]}
    wrong = good | {"claims": [{"_id": call["_id"], "field": "S-000001.bytes", "value": 1.0}]}
    got = task.submit_findings([good, wrong, good | {"evidence": []}, good | {"evidence": [cite | {"ref_id": "S-000009"}]}])
    assert [g["status"] for g in got] == ["accepted", "downgraded", "rejected", "rejected"] and [i["check"] for g in got[1:] for i in g["issues"]] == ["V4", "V1", "V3"]
    with pytest.raises(InvalidArgument):
        task.submit_findings([good | {"evidence": [cite | {"_id": "tc_none"}]}])
    text = render(task, "S-000001 stands out")
    assert all(f"## {s}" in text for s in ("Summary", "Trace")) and "F-002" in text
    with pytest.raises(ValueError):
        render(task, "S-123456 stands out")
    to = store.Store(spark, str(tmp_path / "store"))
    task.persist(to)
    task.persist(to)
    assert "UNVERIFIED" not in text
    kept = list(task.found)
    task.found.append({**kept[0], "title": "S-654321 spoke to 203.0.113.77 | and S-000001"})
    again = render(task)
    task.found[:] = kept
    assert "UNVERIFIED CONTENT: 2 items" in again and "[unverified by engine] spoke to [unverified by engine]" in again and "and S-000001" in again
    task.submit_report_meta(to, {"a": 1})
    assert to.read("sessions").count() == 1 and to.read("findings").count() == 2 and to.read("tool_calls").count() == len(task.calls)
    assert set(to.views()) >= {"sessions", "findings", "analysis_tasks"}
    assert store.read_only_sql(spark, "SELECT id FROM sessions").count() == 1
    assert [r.event for r in task.event_stream("errors_only").orderBy("stage", "seq").collect()] == ["capture_info", "decode_error", "packet", "session_summary"] + ["stats"] * 4


@pytest.mark.parametrize("text", ["DROP TABLE x", "INSERT INTO x SELECT 1", "", "select 1; select 2", "with a as (select 1) insert into x select * from a"])
def test_refused_sql(spark, text):
    with pytest.raises(Exception):
        store.read_only_sql(spark, text).collect()


def test_sql_guard(spark):
    assert store.read_only_sql(spark, "/* c */ SELECT id FROM range(1000)", 7).count() == 7
    assert store.read_only_sql(spark, "EXPLAIN SELECT 1").count() == 1
    with pytest.raises(store.RefusedQuery):
        store.read_only_sql(spark, "SELECT 1", 0)


def test_eight_tasks(spark, tmp_path):
    p = tmp_path / "a.pcap"
    p.write_bytes(synth.classic_file(list(synth.traffic("dns", 2))))
    e = Engine(spark)
    for k in range(9):
        e.analyze(str(p), f"t{k}")
    assert list(e.tasks) == [f"t{k}" for k in range(1, 9)]


def test_ip_order(spark):
    given = ["10.0.0.10", "10.0.0.9", "::1", "2001:db8::1", "9.255.0.1", "fe80::1:2"]
    rows = spark.createDataFrame([(x,) for x in given], "ip string").orderBy(X.ip_key("ip")).collect()
    assert [r.ip for r in rows] == ["9.255.0.1", "10.0.0.9", "10.0.0.10", "::1", "2001:db8::1", "fe80::1:2"]
    assert spark.range(1).select(X.same_ip(F.lit("::1"), F.lit("0:0:0:0:0:0:0:1"))).first()[0]


def test_binary_functions(spark):
    row = spark.range(1).select(X.be_uint(F.lit(b"\x01\x02\xff"), 1, 2).alias("u"), X.mac_text(F.lit(b"\x0a\x00\xff\x01\x02\x03")).alias("m"), X.parse_byte_size(F.lit("8 MiB")).alias("s"), X.precision_class(F.lit(1000)).alias("p"), X.ticks_to_ns(F.lit(5), F.lit(7), F.lit(1000)).alias("t")).first()
    assert tuple(row) == (767, "0a:00:ff:01:02:03", 8 << 20, "ms", 5_007_000_000)


def test_streams_equal_batch(spark, tmp_path):
    from tidewire.operators import rules
    from tidewire.plans.flows import flows

    own = flows(spark, "/root/testdata/sf0.001")
    own.repartition(1).sortWithinPartitions("ts_ns").write.parquet(str(tmp_path / "in"))
    rule = Rule("X-001", 2 * 86_400_000_000_000, "gt", 4, cooldown_ns=86_400_000_000_000, match={"protocol": "tcp"})
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    q = stream_alerts(stream, rule).writeStream.format("memory").queryName("alerts_q").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.grp, r.seq, r.value) for r in spark.table("alerts_q").collect())
    assert got and got == sorted((r.grp, r.seq, r.value) for r in rules.evaluate(own, rule).collect())
    q = windows.tumbling_protocols(stream, "1 day").writeStream.format("memory").queryName("tumbling_q").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("tumbling_q").agg(F.sum("packets")).first()[0] <= own.count()
    q = windows.idle_sessions(stream, "1 hour").writeStream.format("memory").queryName("idle_q").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("idle_q").count() > 0


def test_data_in_order_have_no_limit():
    s, piece = Stream(), b"z" * 65536
    assert {s.feed((1000 + k * len(piece)) & 0xFFFFFFFF, piece)[0] for k in range(320)} == {"in_order"}  # 20 MiB
    assert s.state() == "active" and s.ready_total == 320 * len(piece) and not s.held
    s, v = fed((0, b"a"), *[(10 + 20 * k, b"b" * 10) for k in range(5)], (1, b"c" * 9), limits=Limits(max_segments=3))
    assert s.overflow and s.held == sum(len(d) for _, d in s.waiting) and len(s.waiting) <= 3


def test_placing_against_a_plain_map():
    """Random pieces, with either copy winning, against bytes by position."""
    import random

    r = random.Random(6)
    for first_wins in (True, False):
        for _ in range(60):
            s, plain = Stream(first_wins=first_wins), {}
            s.feed(0, b"s")
            for _ in range(30):
                at, data = r.randint(2, 80), bytes(r.choices(b"abcdef", k=r.randint(1, 15)))
                s.feed(at, data)
                for k, c in enumerate(data):
                    if at + k not in plain or not first_wins:
                        plain[at + k] = c
                assert {a + k: c for a, d in s.waiting for k, c in enumerate(d)} == plain and s.held == len(plain)
                assert all(a + len(d) <= b for (a, d), (b, _) in zip(s.waiting, s.waiting[1:]))


def test_several_captures_are_one_task(spark, tmp_path):
    frames = list(synth.traffic("http", 60))
    (tmp_path / "a.pcap").write_bytes(synth.classic_file(frames))
    (tmp_path / "b.pcapng").write_bytes(synth.block_file(frames[:25]))
    alone = Engine(spark).analyze(str(tmp_path / "a.pcap"))
    both = Engine(spark).analyze(str(tmp_path))
    assert both.packets.count() == 85 and both.packets.select("packet_index").distinct().count() == 85
    assert both.segments.count() == alone.segments.count() + both.segments.where("seq >= 60").count() and both.events.count() == 85
    assert both.packets.where("payload_ref IS NOT NULL AND payload_ref.packet_index <> packet_index").count() == 0
    assert [(r["first"], r.packets) for r in both.files.orderBy("path").collect()] == [(0, 60), (60, 25)]
    assert alone.packets_digest and both.packets_digest is None
    alone.close(), both.close()


def test_notes_of_the_reader(spark, tmp_path):
    from tidewire.sources.capture import read_notes

    whole = synth.block_file(list(synth.traffic("dns", 3)), extra=[(0x0BAD, b"1234")])
    (tmp_path / "a.pcapng").write_bytes(whole)
    got = {(r.kind, r.times) for r in read_notes(spark, str(tmp_path)).collect()}
    assert any(n >= 1 for _, n in got)


def test_stored_answers_of_a_task_that_is_gone(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(synth.classic_file(list(synth.traffic("syn-flood", 300))))
    held = store.Store(spark, str(tmp_path / "store"))
    engine = Engine(spark, stored=held)
    task = engine.analyze(str(tmp_path / "a.pcap"), "task_a")
    live = engine.check_alerts("task_a")
    assert live["content"]["source"] == "memory" and live["content"]["rows"]
    task.persist(held)
    del engine.tasks["task_a"]
    cold = engine.check_alerts("task_a")
    assert cold["content"]["source"] == "database" and cold["_id"] == "tc-cold-task_a"
    assert [r["id"] for r in cold["content"]["rows"]] == [r["id"] for r in live["content"]["rows"]]
    assert len(engine.query_history("task_a", "sessions", 5)) == 5 and engine.query_history("task_a", "alerts")
    assert not engine.check_alerts("task_a", session_id="S-999999")["content"]["rows"]
    with pytest.raises(InvalidArgument):
        Engine(spark).check_alerts("task_a")
    task.close()


def test_migrations(spark, tmp_path):
    held = store.Store(spark, str(tmp_path))
    held.write("alerts", spark.createDataFrame([("a1", "t", 1)], "id string, task_id string, first_ts long"))
    assert [v for v, _ in held.migration_status()["pending"]] == [1, 2]
    assert [v for v, _ in held.apply_migrations()] == [1, 2] and held.apply_migrations() == []
    assert held.read("alerts").columns == ["id", "task_id", "first_ts", "session_id"] and held.read("alerts").count() == 1


def test_summarized_arguments():
    from tidewire.operators.trace import summarized

    assert summarized("x" * 128) == "x" * 128 and summarized("x" * 129) == "<129 chars>" and summarized(b"abc") == "<3 bytes>"
    assert summarized({"a": list(range(40)), "b": ["y" * 200, None, 1.5]}) == {"a": [*range(32), "<8 more>"], "b": ["<200 chars>", None, 1.5]}
