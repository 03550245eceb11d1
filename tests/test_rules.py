import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import rules
from tidewire.operators.rule_files import Rule, RuleError, check_rule, load_rules, parse_rule
from tidewire.streaming.rules import WindowState

MS = 1_000_000
BUILTIN = {r.id: r for r in load_rules()}


def events(spark, rows, **fixed):
    """Rows of (ts_ns, src, dst, dst_port, flags) as flat packets."""
    names = "seq long, ts_ns long, src string, src_port int, dst string, dst_port int, proto string, flags int, length long, dns_entropy float, dns_txt_len long, dns_qname_len int"
    base = {"src": "10.0.0.1", "src_port": 1000, "dst": "10.0.0.2", "dst_port": 80, "proto": "tcp", "flags": 2, "length": 60, "dns_entropy": None, "dns_txt_len": None, "dns_qname_len": None} | fixed
    return spark.createDataFrame([tuple(({"seq": k, "ts_ns": ts} | base | own)[n.split()[0]] for n in names.split(", ")) for k, (ts, own) in enumerate(rows)], names)


@pytest.mark.parametrize("n,alerts", [(99, 0), (100, 0), (101, 1)])
def test_exact_threshold(spark, n, alerts):
    assert rules.evaluate(events(spark, [(k * MS, {}) for k in range(n)]), BUILTIN["NET-TCP-SYN-BURST-001"]).count() == alerts


def test_cooldown_and_groups(spark):
    rule = BUILTIN["NET-TCP-SYN-BURST-001"]
    assert rules.evaluate(events(spark, [(k * MS, {}) for k in range(400)]), rule).count() == 1
    assert rules.evaluate(events(spark, [(k * MS, {"src": f"10.0.0.{k % 2}"}) for k in range(120)]), rule).count() == 0
    again = [(k * MS, {}) for k in range(150)] + [(70_000 * MS + k * MS, {}) for k in range(150)]
    assert rules.evaluate(events(spark, again), rule).count() == 2


def test_distinct_ports(spark):
    rule = BUILTIN["NET-TCP-PORT-SWEEP-001"]
    rows = [(k * MS, {"dst_port": k}) for k in range(51)]
    got = rules.evaluate(events(spark, rows), rule, with_evidence=True).collect()
    assert len(got) == 1 and got[0].value == 51 and got[0].sample_packets == [0, 12, 25, 37, 50]
    assert rules.evaluate(events(spark, rows[:50] + rows[:50]), rule).count() == 0


def test_entropy_is_compared_as_single_float(spark):
    rule = BUILTIN["NET-DNS-SUSPICIOUS-001"]
    many = lambda n, e: events(spark, [(k * MS, {}) for k in range(n)], proto="udp", dst_port=53, flags=0, dns_entropy=e)
    assert rules.evaluate(many(1000, 1.2), rule).count() == 0
    assert rules.evaluate(many(201, 4.2), rule).count() == 1
    assert rules.evaluate(many(300, 3.5), rule).count() == 0


def test_malformed_is_cumulative(spark):
    rule = BUILTIN["NET-MALFORMED-BURST-001"]
    errors = lambda n: spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * 3_600_000_000_000).alias("ts_ns"), F.lit("ipv4").alias("layer"), F.lit("truncated_header").alias("code"))
    assert rules.evaluate(errors(500), rule).count() == 0
    assert rules.evaluate(errors(501), rule).where("value = 501").count() == 1


def test_ratio_and_ports(spark):
    rule = Rule("X-001", 60_000_000_000, "gt", 0.5, metric="ratio", field="dns.txt_len", field_gt=100, group_by=("dst_ip",), match={"protocol": "udp", "src_port": 53})
    got = rules.evaluate(events(spark, [(k * MS, {}) for k in range(10)], proto="udp", src_port=53, dns_txt_len=200), rule).collect()
    assert len(got) == 1 and got[0].value == 1.0 and got[0].seq == 0
    either = Rule("X-002", 60_000_000_000, "gt", 1, match={"any_port": 53}, group_by=("protocol",))
    both = events(spark, [(0, {"dst_port": 53}), (MS, {"src_port": 53}), (2 * MS, {})], proto="udp")
    assert [r.seq for r in rules.evaluate(both, either).collect()] == [1]


def test_order_and_partitions_do_not_matter(spark):
    rule = Rule("X-003", 50 * MS, "gt", 3, group_by=("src_ip",), cooldown_ns=20 * MS)
    rows = [(k * 7 % 400 * MS, {"src": f"10.0.0.{k % 3}"}) for k in range(400)]
    frame = events(spark, rows)
    want = sorted(map(tuple, rules.evaluate(frame, rule).collect()))
    assert want and sorted(map(tuple, rules.evaluate(frame.orderBy(F.rand(4)).repartition(7), rule).collect())) == want


@pytest.mark.parametrize("metric,field", [("count", None), ("sum_bytes", "captured_len"), ("distinct_count", "dst_port"), ("ratio", "captured_len")])
def test_batch_equals_the_fold(spark, metric, field):
    rule = Rule("X-004", 40 * MS, "gt", {"ratio": 0.4, "sum_bytes": 400}.get(metric, 4), metric=metric, field=field, field_gt=70 if metric == "ratio" else None, cooldown_ns=30 * MS)
    rows = [((k * k * 13) % 997 * MS, {"src": f"10.0.0.{k % 4}", "dst_port": k % 7, "length": 40 + k % 70}) for k in range(500)]
    got = {(r.grp, r.seq): r.value for r in rules.evaluate(events(spark, rows), rule).collect()}
    want, states = {}, {}
    for k, (ts, own) in sorted(enumerate(rows), key=lambda r: (r[1][0], r[0])):
        state = states.setdefault(own["src"], WindowState(rule))
        x = {"dst_port": own["dst_port"], "captured_len": own["length"]}.get(field)
        value = state.feed(ts, None if x is None else str(x), own["length"])
        if state.fires(value, ts):
            want[f"src_ip={own['src']}", k] = value
    assert want and got == pytest.approx(want)


def test_windows_at_the_edges_of_stretches(spark):
    """Nanoseconds just before and after the ends of stretches, where doubles would round."""
    rule = Rule("X-006", 1000, "gte", 2, cooldown_ns=0)
    edge = 106_250_000_000_000 * 16_000
    rows = [(edge + d, {}) for d in (-1001, -1000, -999, -1, 0, 1, 999, 1000, 1001)]
    got = {r.seq: r.value for r in rules.window_values(rules.matched_events(events(spark, rows), rule), 1000).collect()}
    times = [r[0] for r in rows]
    assert got == {k: sum(t - 1000 <= u <= t for u in times) for k, t in enumerate(times)}


def test_degraded_window():
    state = WindowState(Rule("X-005", 10**18, "gt", 1), strict=True)
    values = [state.feed(k, None, 1) for k in range(5000)]
    assert state.degraded and max(values) == 4096


GOOD = """
id: NET-X-001
match: {protocol: tcp}
threshold: {metric: count, group_by: [src_ip], window: 10s, operator: gt, value: 5}
description: d
"""


@pytest.mark.parametrize(
    "change,check",
    [
        ({"id: NET-X-001": "id: net-x-1"}, "S1"),
        ({"metric: count": "metric: distinct_count"}, "S2"),
        ({"metric: count": "metric: distinct_count, field: http.host"}, "S3"),
        ({"window: 10s": "window: 7s"}, "S4"),
        ({"protocol: tcp": "protocol: udp, flags: {contains: [SYN]}"}, "S5"),
        ({"protocol: tcp": "protocol: tcp, flags: {contains: [ZAP]}"}, "S5"),
        ({"protocol: tcp": "protocol: udp, dst_port: 54, dns: {entropy_gt: 1.0}"}, "S6"),
        ({"metric: count": "metric: ratio, field: dns.txt_len, field_gt: 1"}, "S7"),
        ({"group_by: [src_ip]": "group_by: []"}, "S9"),
        ({"protocol: tcp": "protocol: icmp, any_port: 1"}, "S10"),
    ],
)
def test_checks(change, check):
    text = GOOD
    for a, b in change.items():
        text = text.replace(a, b)
    rule, raw = parse_rule(text)
    errors, _ = check_rule(rule, raw)
    assert any(e.startswith(check + ":") for e in errors), errors


def test_form_and_folders(tmp_path):
    for bad in ("a: [", "id: X-001", GOOD + "extra: 1", GOOD.replace("protocol", "protokol"), GOOD.replace("operator: gt", "operator: over")):
        with pytest.raises(RuleError):
            parse_rule(bad)
    assert check_rule(*parse_rule(GOOD.replace("description: d", "")))[1][0].startswith("S8")
    (tmp_path / "NET-X-001.yaml").write_text(GOOD)
    (tmp_path / "NET-TCP-SYN-BURST-001.yml").write_text(GOOD.replace("NET-X-001", "NET-TCP-SYN-BURST-001"))
    (tmp_path / "NET-Y-001.yaml").write_text("nope")
    with pytest.raises(RuleError):
        load_rules(tmp_path)
    got = load_rules(tmp_path, strict=False)
    assert len(got) == 5 and [d[0] for d in got.dead] == ["NET-Y-001.yaml"] and got.rules["NET-TCP-SYN-BURST-001"].value == 5
    assert len({r.hash for r in got}) == 5


def plain_cooldown(rows, cooldown_ns):
    out, until = [], {}
    for grp, now, seq in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        if grp not in until or now >= until[grp]:
            out.append((grp, now, seq))
            until[grp] = now + cooldown_ns
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed,span,cooldown_ns", [(1, 2000, 7), (2, 10**6, 5000), (3, 300, 1), (4, 10**5, 10**6), (5, 10**4, 0)])
def test_cooldown_equals_a_walk(spark, seed, span, cooldown_ns):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", "rare", None]) if r.random() < 0.4 else "hot", r.randrange(-span, span), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "grp string, now_ns long, seq long").withColumn("value", F.lit(1.5))
    found = rules.cooled(frame, cooldown_ns)
    assert found.columns == frame.columns
    want = sorted(map(repr, rows)) if cooldown_ns == 0 else plain_cooldown(rows, cooldown_ns)
    assert sorted(repr((x.grp, x.now_ns, x.seq)) for x in found.collect()) == want


def test_cooldown_of_one_flooding_group(spark):
    n = 1_000_000
    frame = spark.range(n).select(F.lit("one").alias("grp"), (F.col("id") * 3).alias("now_ns"), F.col("id").alias("seq")).repartition(8)
    found = [x.now_ns for x in rules.cooled(frame, 1000).collect()]
    assert sorted(found) == list(range(0, 3 * n, 1002))


@pytest.mark.parametrize("metric,field,value", [("count", None, 5), ("sum_bytes", "captured_len", 400), ("distinct_count", "dst_port", 3)])
def test_windows_fed_by_arrival_equal_a_plain_fold(spark, metric, field, value):
    r = random.Random(11)
    times = [k * MS + r.choice([0, 0, 0, -40, 25]) * MS for k in range(600)]
    frame = events(spark, [(ts, {"src": f"10.0.0.{r.randrange(3)}", "dst_port": r.randrange(6), "length": r.randrange(100)}) for ts in times])
    rule = Rule("ARRIVAL-001", 20 * MS, "gt", float(value), metric=metric, field=field, cooldown_ns=15 * MS, group_by=("src_ip",), match={"protocol": "tcp"})
    held, top, want = {}, {}, []
    for e in rules.matched_events(frame, rule).orderBy("seq").collect():
        window = held.setdefault(e.grp, WindowState(rule))
        top[e.grp] = max(e.ts_ns, top.get(e.grp, e.ts_ns))
        found = window.feed(e.ts_ns, e.x, e.bytes)
        if window.fires(found, top[e.grp]):
            want.append((e.grp, e.seq, e.ts_ns, top[e.grp], found))
    got = rules.evaluate(frame, rule, compat=True, with_evidence=True)
    assert sorted((x.grp, x.seq, x.ts_ns, x.now_ns, x.value) for x in got.collect()) == sorted(want) and len(want) > 10
    in_order = rules.evaluate(frame, rule).count()
    assert in_order and all(x.last_ts == x.ts_ns for x in got.collect())
