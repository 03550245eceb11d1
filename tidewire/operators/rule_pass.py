"""Many rules in one pass: each event is tagged with the rules it meets, and one shuffle by (rule, group, stretch) serves them all.

How it scales. The source is scanned once, whatever the number of rules: what is kept of an event is a narrow row for each rule whose match it meets, and
events that meet none go before any shuffle. Windows of all lengths are running sums of begins and ends: an event counts from its own time until it
leaves its rule's window (or, for distinct counts, until its value comes again), so no frame depends on a rule. A group is cut into stretches of 16 of its
rule's windows, each with a copy of one window before it; a stretch with many events is summed in slices, which are added up. Only events over their threshold, and the last one of each stretch, go on from there.
The capture's last time, which the final look at each group needs, is observed while the source is scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div
from ..shared import materialize
from .filters import threshold_met
from .rule_files import Rule
from .rules import ERRORS_A_STRETCH, FIELD_COLUMNS, TEXT_FIELDS, cooled, evidence, group_column, match_column, running_counts, slice_of, stretched

#: Columns of the event contract that rules read.
READ = ("seq", "ts_ns", "now_ns", "proto", "flags", "length", "key", "layer", "code", *FIELD_COLUMNS.values())
COUNTED = ["rule", "grp", "seq", "ts_ns", "now_ns", "value"]


def _of_rule(values: Sequence, kind: str) -> Column:
    """The entry of ``values`` (one for each rule) that belongs to a row's rule."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("rule") + 1)


def _field(rule: Rule, columns: list[str]) -> Column | None:
    """The rule's field, or None where the events don't have it."""
    name = FIELD_COLUMNS.get(rule.field)
    return F.col(name) if name in columns else None


def _tag(number: int, rule: Rule, columns: list[str]) -> tuple[Column, Column]:
    """(whether an event counts for a rule, what is kept of it)."""
    field, meets = _field(rule, columns), match_column(rule, columns)
    x, hit = F.lit(None).cast("string"), F.lit(False)
    if rule.metric == "distinct_count":
        x = x if field is None else field.cast("string")
        meets = meets & x.isNotNull()
    elif rule.metric == "ratio":
        share = F.lit(None).cast("double") if field is None or rule.field in TEXT_FIELDS else field.cast("double")
        meets, hit = meets & share.isNotNull(), share > rule.field_gt
    weight = F.lit(1)
    if rule.metric == "sum_bytes":
        weight = F.lit(0) if rule.decode_scope or rule.scope == "session" else F.coalesce(F.col("length"), F.lit(0))
    own = F.concat(F.lit(f"{number:04d}|"), group_column(rule, columns))
    return meets, F.struct(F.lit(number).alias("rule"), own.alias("grp"), weight.cast("long").alias("weight"), x.alias("x"), hit.alias("hit"))


def tagged(events: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(seq, ts_ns, now_ns, rule, grp, weight, x, hit): an event for each of the numbered rules it meets; the rule's number leads the group's name.

    Nulls in what a match looks at don't meet it; repeated events count each. All rules have to be of one scope.
    """
    columns = events.columns
    tags = [_tag(k, r, columns) for k, r in rules]
    ts = F.lit(0).cast("long") if rules[0][1].decode_scope else F.col("ts_ns")
    now = F.col("now_ns") if "now_ns" in columns else F.col("ts_ns")
    some = events.where(reduce(lambda a, b: a | b, [meets for meets, _ in tags]))
    met = F.filter(F.array(*[F.when(meets, kept) for meets, kept in tags]), lambda t: t.isNotNull())
    return some.select(F.col("seq").cast("long").alias("seq"), ts.alias("ts_ns"), now.cast("long").alias("now_ns"), F.inline(met))


def window_values_of_all(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """COUNTED and last: the value of its rule at each tagged event, and whether it is its stretch's last."""
    return _whole(_stretches(events, rules), rules)


def _stretches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return stretched(events, _of_rule([r.window_ns for r in rules], "long"))


def _whole(cut: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Values of events in their stretches, a stretch in a task."""
    width = _of_rule([r.window_ns for r in rules], "long")
    distinct = [k for k, r in enumerate(rules) if r.metric == "distinct_count"]
    # All windows below lie within (grp, stretch), so this is the only exchange.
    cut = cut.repartition("grp", "stretch")
    by = Window.partitionBy("grp", "stretch")
    gone_t, gone_q = F.col("ts_ns") + width + 1, F.lit(-(1 << 62)).cast("long")
    if distinct:
        again = Window.partitionBy("grp", "stretch", "x").orderBy("ts_ns", "seq")
        cut = cut.withColumns({"_nt": F.lead("ts_ns").over(again), "_nq": F.lead("seq").over(again)})
        soon = F.col("rule").isin(distinct) & F.coalesce(F.col("_nt") <= F.col("ts_ns") + width, F.lit(False))
        gone_t, gone_q = F.when(soon, F.col("_nt")).otherwise(gone_t), F.when(soon, F.col("_nq")).otherwise(gone_q)
    hit = F.col("hit").cast("long")
    step = lambda t, q, k, sign: F.struct(t.alias("t"), q.alias("q"), F.lit(k).alias("k"), (F.col("weight") * sign).alias("d"), (hit * sign).alias("h"))
    steps = cut.withColumn("_step", F.explode(F.array(step(F.col("ts_ns"), F.col("seq"), 1, 1), step(gone_t, gone_q, 0, -1))))
    upto = by.orderBy("_step.t", "_step.q", "_step.k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.withColumns({"_s": F.sum("_step.d").over(upto), "_h": F.sum("_step.h").over(upto)})
    ratio = F.col("rule").isin([k for k, r in enumerate(rules) if r.metric == "ratio"])
    value = F.when(ratio, F.col("_h") / F.col("_s")).otherwise(F.col("_s").cast("double"))
    own = summed.where("_step.k = 1 AND NOT ahead")
    last = F.lead("seq").over(by.orderBy("_step.t", "_step.q", "_step.k")).isNull()
    return own.select("rule", "grp", "seq", "ts_ns", "now_ns", value.alias("value"), last.alias("last"))


#: Rows of a group's stretch from which on it is summed slice by slice.
BUSY = 1 << 17


def sliced_steps(cut: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Events in their stretches, each as the begin and the end of what it counts for, with the slice of time that the step is in."""
    width = _of_rule([r.window_ns for r in rules], "long")
    distinct = F.col("rule").isin([k for k, r in enumerate(rules) if r.metric == "distinct_count"])
    gone_t, gone_q = F.col("ts_ns") + width + 1, F.lit(-(1 << 62)).cast("long")
    # A value ends where it comes again; events of rules that don't look at values stay where they are.
    again = Window.partitionBy("grp", "stretch", "x").orderBy("ts_ns", "seq")
    nexts = cut.where(distinct).withColumns({"_nt": F.lead("ts_ns").over(again), "_nq": F.lead("seq").over(again)})
    soon = F.coalesce(F.col("_nt") <= F.col("ts_ns") + width, F.lit(False))
    valued = nexts.withColumns({"_gt": F.when(soon, F.col("_nt")).otherwise(gone_t), "_gq": F.when(soon, F.col("_nq")).otherwise(gone_q)}).drop("_nt", "_nq")
    events = cut.where(~distinct).withColumns({"_gt": gone_t, "_gq": gone_q}).unionByName(valued)
    hit = F.col("hit").cast("long")
    step = lambda t, q, k, sign: F.struct(F.col(t).alias("t"), F.col(q).alias("q"), F.lit(k).alias("k"), (F.col("weight") * sign).alias("d"), (hit * sign).alias("h"))
    both = events.withColumn("_step", F.explode(F.array(step("ts_ns", "seq", 1, 1), step("_gt", "_gq", 0, -1))))
    return both.select("rule", "grp", "stretch", "ahead", "seq", "ts_ns", "now_ns", "_step", floor_div("_step.t", slice_of(width)).alias("slice"))


def _sliced(cut: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What :func:`_whole` gives, for busy stretches: steps are summed slice by slice, and a stretch's slices, a row each, are added up. Last is a slice's last."""
    own = ["grp", "stretch", "slice"]
    steps = sliced_steps(cut, rules).repartition(*own)
    sums = steps.groupBy(*own).agg(F.sum("_step.d").alias("_sd"), F.sum("_step.h").alias("_sh"))
    before = Window.partitionBy("grp", "stretch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*own, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("_sd", "_bd"), ("_sh", "_bh"))])
    order = Window.partitionBy(*own).orderBy("_step.t", "_step.q", "_step.k")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = steps.withColumns({"_rd": F.sum("_step.d").over(upto), "_rh": F.sum("_step.h").over(upto)}).where("_step.k = 1 AND NOT ahead")
    placed = summed.withColumn("last", F.lead("seq").over(order).isNull()).join(heads, own)
    total = F.col("_bd") + F.col("_rd")
    ratio = F.col("rule").isin([k for k, r in enumerate(rules) if r.metric == "ratio"])
    value = F.when(ratio, (F.col("_bh") + F.col("_rh")) / total).otherwise(total.cast("double"))
    return placed.select("rule", "grp", "seq", "ts_ns", "now_ns", value.alias("value"), "last")


def spread_values(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """:func:`window_values_of_all` of events that may be read twice, with busy stretches spread over tasks."""
    cut = _stretches(events, rules)
    # A row for each BUSY rows of input at most.
    busy = cut.groupBy("grp", "stretch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUSY).select("grp", "stretch").collect()
    if not busy:
        return _whole(cut, rules)
    named = F.broadcast(cut.sparkSession.createDataFrame(busy, "grp string, stretch long"))
    of = lambda how: cut.join(named, ["grp", "stretch"], how)
    return _whole(of("left_anti"), rules).unionByName(_sliced(of("left_semi"), rules))


def _counts(events: DataFrame) -> DataFrame:
    """COUNTED and last for rules that count decode errors, which have no times: the running count of the group."""
    last = F.lead("seq").over(Window.partitionBy("grp", floor_div("seq", ERRORS_A_STRETCH)).orderBy("seq", "value")).isNull()
    return running_counts(events).select(*COUNTED, last.alias("last"))


def _over(rules: Sequence[Rule]) -> Column:
    """Whether a value is over its rule's threshold."""
    out = F.lit(False)
    for k, r in enumerate(rules):
        out = F.when(F.col("rule") == k, threshold_met(F.col("value"), r.operator, r.value)).otherwise(out)
    return out


def _cooled_by_rule(candidates: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Cooldowns are few fixed values, so rules with the same one pass together."""
    parts = []
    for cooldown in sorted({r.cooldown_ns for r in rules}):
        own = [k for k, r in enumerate(rules) if r.cooldown_ns == cooldown]
        parts.append(cooled(candidates.where(F.col("rule").isin(own)), cooldown))
    return reduce(DataFrame.unionByName, parts)


def evaluate_together(scopes: Sequence[tuple[DataFrame, Sequence[Rule]]], flush: bool = False, with_evidence: bool = False) -> DataFrame:
    """Alerts of many rules: (rule_id, severity, rule_hash, grp, seq, ts_ns, now_ns, value), and evidence if asked for, as the rules give one by one.

    ``scopes`` are tables of events, each with the rules over it; each is scanned once. Rules that share an id stay apart. Empty tables give no alerts, and at
    least one scope with a rule is needed.
    """
    # Rules over decode errors look at the same table without its times.
    scopes = [(events, some) for events, own in scopes for errors in (False, True) if (some := [r for r in own if r.decode_scope == errors])]
    if not scopes:
        raise ValueError("there is no rule to look for")
    rules = [r for _, own in scopes for r in own]
    finals: list[tuple[Observation, int]] = []
    tables, at = [], 0
    for events, own in scopes:
        read = events.select(*[c for c in READ if c in events.columns])
        if flush:
            seen = Observation()
            read = read.observe(seen, F.max("now_ns" if "now_ns" in read.columns else "ts_ns").cast("long").alias("final"))
            finals.append((seen, len(own)))
        tables.append(tagged(read, list(enumerate(own, at))))
        at += len(own)
    events = reduce(DataFrame.unionByName, tables)
    events = materialize(events, "tagged")  # the windows read it, and the evidence
    counting = [k for k, r in enumerate(rules) if r.decode_scope and r.metric == "count"]
    windowed = [k for k in range(len(rules)) if k not in counting]
    make: list[Callable[[], DataFrame]] = []
    if windowed:
        make.append(lambda: spread_values(events.where(F.col("rule").isin(windowed)), rules))
    if counting:
        make.append(lambda: _counts(events.where(F.col("rule").isin(counting))))
    values = reduce(DataFrame.unionByName, [m() for m in make])
    marked = values.withColumn("over", _over(rules)).where((F.col("over") | F.col("last")) if flush else F.col("over"))
    marked = materialize(marked, "marked") if flush else marked
    over = marked.where("over").select(*COUNTED)
    if flush:
        last = marked.where("last").groupBy("rule", "grp").agg(F.max(F.struct("ts_ns", "seq", "value", "over")).alias("l")).where("l.over")
        final = _of_rule([seen.get.get("final") for seen, n in finals for _ in range(n)], "long")
        again = last.select("rule", "grp", F.col("l.seq").alias("seq"), F.col("l.ts_ns").alias("ts_ns"), final.alias("now_ns"), F.col("l.value").alias("value"))
        over = over.withColumn("_last", F.lit(0)).unionByName(again.withColumn("_last", F.lit(1)))
    fired = _cooled_by_rule(over, rules).select(*COUNTED)
    if with_evidence:
        fired = evidence(fired, events, _of_rule([r.window_ns for r in rules], "long"))
    named = [_of_rule([getattr(r, a) for r in rules], "string").alias(b) for a, b in (("id", "rule_id"), ("severity", "severity"), ("hash", "rule_hash"))]
    more = ["first_ts", "last_ts", "first_packet", "last_packet", "sample_packets"] if with_evidence else []
    return fired.select(*named, F.expr("substr(grp, 6)").alias("grp"), "seq", "ts_ns", "now_ns", "value", *more)


def evaluate_all(packets: DataFrame, rules, errors: DataFrame | None = None, session_frame: DataFrame | None = None, flush: bool = True) -> DataFrame:
    """Alerts of all rules, those of each scope in one pass over its events, as one table with evidence and deterministic ids."""
    rules = list(rules)
    scopes = [(packets, [r for r in rules if not r.decode_scope and r.scope != "session"])]
    if session_frame is not None:
        events = session_frame.select(F.lit(0).cast("long").alias("seq"), F.col("first_ts").alias("ts_ns"), F.col("last_ts").alias("now_ns"), "proto", "key")
        scopes.append((events, [r for r in rules if not r.decode_scope and r.scope == "session"]))
    if errors is not None:
        source = errors.withColumn("seq", F.col("packet_index")) if "seq" not in errors.columns else errors
        source = source.withColumn("now_ns", F.col("ts_ns")) if "now_ns" not in source.columns and "ts_ns" in source.columns else source
        scopes.append((source, [r for r in rules if r.decode_scope]))
    out = evaluate_together(scopes, flush=flush, with_evidence=True)
    return out.withColumn("id", F.concat(F.lit("alert_"), F.upper(F.substring(F.sha2(F.concat_ws("|", "rule_id", "grp", "seq", "now_ns"), 256), 1, 26))))
