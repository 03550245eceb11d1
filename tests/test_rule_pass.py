"""Many rules in one pass give what each of them gives alone."""

import random

import pytest

from tidewire.operators import rule_pass, rules
from tidewire.operators.rule_files import EXAMPLES, Rule, load_rules

S = 1_000_000_000
EVENTS = "seq long, ts_ns long, src string, src_port int, dst string, dst_port int, proto string, flags int, length long, dns_txt_len int, tls_sni string, extra string"
COLUMNS = ["rule_id", "grp", "seq", "ts_ns", "now_ns", "value"]
EVIDENCE = ["first_ts", "last_ts", "first_packet", "last_packet", "sample_packets"]
RULES = [
    Rule("T-COUNT-001", 10 * S, "gt", 1.0, match={"protocol": "tcp"}, cooldown_ns=30 * S),
    Rule("T-BYTES-001", 5 * S, "gte", 900.0, metric="sum_bytes", field="captured_len", group_by=("src_ip", "dst_ip"), cooldown_ns=10 * S),
    Rule("T-PORTS-001", 30 * S, "gt", 4.0, metric="distinct_count", field="dst_port", group_by=("src_ip",), cooldown_ns=30 * S),
    Rule("T-NAMES-001", 60 * S, "gt", 2.0, metric="distinct_count", field="tls.sni", group_by=("dst_ip",), cooldown_ns=0),
    Rule("T-RATIO-001", 60 * S, "gt", 0.5, metric="ratio", field="dns.txt_len", field_gt=100.0, group_by=("dst_ip",), cooldown_ns=60 * S),
    Rule("T-FEW-001", S, "lte", 1.0, group_by=("protocol",), cooldown_ns=60 * S),
]


def some_events(n: int, seed: int):
    pick = random.Random(seed)
    at, rows = 0, []
    for k in range(n):
        at += pick.choice((0, 0, S // 3, S, 2 * S, 15 * S))
        maybe = lambda v: None if pick.random() < 0.1 else v
        rows.append((k, at, maybe(f"10.0.0.{pick.randrange(3)}"), 40000, maybe(f"10.1.0.{pick.randrange(2)}"), maybe(pick.randrange(9)), maybe(pick.choice(("tcp", "udp"))), pick.randrange(32), maybe(pick.randrange(600)), maybe(pick.randrange(200)), maybe(pick.choice("abcde")), "x"))
    return rows


def plain(frame, names):
    return sorted((tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("flush", [False, True])
@pytest.mark.parametrize("with_evidence", [False, True])
def test_together_equals_one_by_one(spark, flush, with_evidence):
    frame = spark.createDataFrame(some_events(600, 3 + flush), EVENTS)
    names = COLUMNS + (EVIDENCE if with_evidence else [])
    want = [r for rule in RULES for r in plain(rules.evaluate(frame, rule, flush, with_evidence), names)]
    got = plain(rule_pass.evaluate_together([(frame, RULES)], flush, with_evidence), names)
    assert {r[0] for r in got} == {r.id for r in RULES}
    assert got == sorted(want, key=repr)


def test_scopes_and_decode_errors(spark):
    packets = spark.createDataFrame(some_events(50, 9), EVENTS)
    errors = spark.createDataFrame([(k, k * S, k * S, "tcp", "ab"[k % 2]) for k in range(90)], "seq long, ts_ns long, now_ns long, layer string, code string")
    count = Rule("T-CODES-001", 10 * S, "gt", 20.0, group_by=("decode_code",), match={"decode_layer": "any"}, cooldown_ns=30 * S)
    kinds = Rule("T-KINDS-001", 10 * S, "gte", 2.0, group_by=("decode_code",), match={"decode_layer": "tcp"}, cooldown_ns=60 * S)
    got = rule_pass.evaluate_together([(packets, RULES[:1]), (errors, [count, kinds])], flush=True)
    want = [r for f, rule in ((packets, RULES[0]), (errors, count), (errors, kinds)) for r in plain(rules.evaluate(f, rule, True), COLUMNS)]
    assert plain(got, COLUMNS) == sorted(want, key=repr) and len({r[0] for r in want}) > 1


def test_empty_tables_and_events_without_a_rules_columns(spark):
    nothing = spark.createDataFrame([], EVENTS)
    assert rule_pass.evaluate_together([(nothing, RULES)], flush=True, with_evidence=True).count() == 0
    bare = spark.createDataFrame([(k, k, "a", "b", "tcp", 1) for k in range(9)], "seq long, ts_ns long, src string, dst string, proto string, length long")
    found = rule_pass.evaluate_together([(bare, [RULES[0], RULES[3], RULES[4]])])
    assert {r.rule_id for r in found.collect()} == {"T-COUNT-001"}
    with pytest.raises(ValueError):
        rule_pass.evaluate_together([(bare, [])])


def test_one_scan_and_one_exchange_before_candidates(spark, tmp_path):
    spark.createDataFrame(some_events(50, 5), EVENTS).write.parquet(str(tmp_path / "e"))
    frame = spark.read.parquet(str(tmp_path / "e"))
    values = rule_pass.window_values_of_all(rule_pass.tagged(frame, list(enumerate(RULES))), RULES)
    plan = values._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "extra" not in plan.split("ReadSchema")[1]


def test_a_flooding_group_is_spread(spark):
    rows = [(k, k * S // 100, "10.0.0.1", 1, "10.0.0.2", k % 7, "tcp", 2, 1, None, None, "x") for k in range(40_000)]
    cut = rules.stretched(rule_pass.tagged(spark.createDataFrame(rows, EVENTS), [(0, RULES[0])]), 10 * S)
    sizes = [r["count"] for r in cut.groupBy("grp", "stretch").count().collect()]
    assert len(sizes) == 3 and max(sizes) <= 17 * 1000 + 1


def test_examples_are_sound():
    own = load_rules(EXAMPLES, builtin=False)
    assert len(own) == 3 and not own.dead and not own.warnings
    assert len(load_rules(EXAMPLES)) == 7


def test_a_busy_stretch_is_spread_and_gives_the_same(spark, monkeypatch):
    """A flood within one window: its stretch can't be cut by windows, but by slices of one."""
    rows = [(k, k * S // 4000, "10.0.0.1", 1, "10.0.0.2", k % 97, "tcp", 2, 1, None, None, "x") for k in range(40_000)]
    flood = spark.createDataFrame(rows + [(50_000 + k, *r[1:]) for k, r in enumerate(some_events(300, 3))], EVENTS)
    numbered = list(enumerate(RULES))
    cut = rule_pass._stretches(rule_pass.tagged(flood, numbered[:1]), RULES)
    sizes = [r["count"] for r in rule_pass.sliced_steps(cut, RULES).groupBy("grp", "stretch", "slice").count().collect()]
    assert sum(sizes) >= 80_000 and max(sizes) <= 80_000 / 15
    tags = rule_pass.tagged(flood, numbered)
    columns = ["rule", "grp", "seq", "ts_ns", "now_ns", "value"]
    monkeypatch.setattr(rule_pass, "BUSY", 100)
    assert plain(rule_pass.spread_values(tags, RULES), columns) == plain(rule_pass.window_values_of_all(tags, RULES), columns)
