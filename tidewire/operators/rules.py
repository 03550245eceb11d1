"""Windowed rules as DataFrame operations: match, group, sliding event-time window, threshold, cooldown, evidence.

The event contract is the flat packet contract, with ``fields`` the rule may name. Windows are sliding: the value at
an event covers the group's events with ts in [ts - window, ts] that came no later (by ts, then seq).

How it scales. The match filters before any shuffle. A window never needs more than its own length of the past, so a
group is cut into stretches of time, each with a copy of the window's length before it; a flooding source then
spreads over as many tasks as it has stretches. Counts and sums are differences of two growing frames, distinct counts
are running sums of begins and ends, so each costs one pass however long the window is. The cooldown is composed of stretches
too: each tells what it makes of the time until which its group is quiet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flags_to_mask, floor_div, group_key, session_key
from ..shared import materialize
from .filters import port_condition, threshold_met
from .rule_files import Rule

#: Columns of the event contract by the names that rules use.
FIELD_COLUMNS = {"src_ip": "src", "dst_ip": "dst", "src_port": "src_port", "dst_port": "dst_port", "captured_len": "length", "dns.qname": "dns_qname", "dns.qname_len": "dns_qname_len", "dns.entropy": "dns_entropy", "dns.txt_len": "dns_txt_len", "tls.sni": "tls_sni"}
TEXT_FIELDS = frozenset({"src_ip", "dst_ip", "dns.qname", "tls.sni"})


def match_column(rule: Rule, columns: list[str]) -> Column:
    """A rule's match as one condition. A DNS number that is missing counts as 0."""
    m, out = rule.match, F.lit(True)
    if rule.decode_scope:
        if m.get("decode_layer", "any") != "any":
            out = out & (F.col("layer") == m["decode_layer"])
        if "decode_code" in m:
            out = out & (F.col("code") == m["decode_code"])
        return out
    if "protocol" in m:
        out = out & (F.lower("proto") == m["protocol"].lower())
    if rule.scope == "session":
        return out
    if flags := m.get("flags"):
        mask = lambda names: flags_to_mask(F.array(*map(F.lit, names))) if names else F.lit(0)
        want, not_ = mask(flags.get("contains") or ()), mask(flags.get("excludes") or ())
        out = out & (F.col("flags").bitwiseAND(want) == want) & (F.col("flags").bitwiseAND(not_) == 0)
    for key in ("src_port", "dst_port"):
        if key in m:
            out = out & port_condition(F.col(key), m[key])
    if "any_port" in m:
        out = out & (port_condition(F.col("src_port"), m["any_port"]) | port_condition(F.col("dst_port"), m["any_port"]))
    for key, column in (("qname_len_gt", "dns_qname_len"), ("txt_len_gt", "dns_txt_len"), ("entropy_gt", "dns_entropy")):
        if key in (m.get("dns") or {}):
            value = F.coalesce(F.col(column), F.lit(0)) if column in columns else F.lit(0)
            kind = "float" if key == "entropy_gt" else "long"  # entropies are compared as single floats
            out = out & (value.cast(kind) > F.lit(m["dns"][key]).cast(kind))
    return out


def group_column(rule: Rule, columns: list[str]) -> Column:
    """The group as k=v text in the order of group_by; missing values are empty, a missing protocol is unknown."""
    has = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    parts = {}
    for g in rule.group_by:
        if g == "protocol":
            parts[g] = F.coalesce(has("proto"), F.lit("unknown"))
        elif g == "session":
            parts[g] = has("key") if "key" in columns else session_key(has("proto"), has("src"), has("src_port"), has("dst"), has("dst_port"))
        elif g == "decode_code":
            parts[g] = has("code")
        else:
            parts[g] = has(FIELD_COLUMNS[g])
    return group_key(**parts)


#: A stretch of time is this many windows long, so copies are a sixteenth of the events at most.
WINDOWS_A_STRETCH = 16


#: A window is cut into this many slices where its packets are ranked or summed.
SLICES_A_WINDOW = 16


def slice_of(window_ns: int | Column) -> Column:
    """The length of a slice of a window."""
    return F.greatest(floor_div(F.lit(window_ns).cast("long"), SLICES_A_WINDOW), F.lit(1).cast("long"))


def matched_events(events: DataFrame, rule: Rule) -> DataFrame:
    """(grp, seq, ts_ns, now_ns, bytes, x) of the events that a rule matches."""
    columns = events.columns
    x = F.lit(None).cast("string")
    if rule.field is not None and FIELD_COLUMNS[rule.field] in columns:
        x = F.col(FIELD_COLUMNS[rule.field])
        x = (F.lit(None).cast("double") if rule.field in TEXT_FIELDS else x.cast("double")) if rule.metric == "ratio" else x.cast("string")
    elif rule.metric == "ratio":
        x = F.lit(None).cast("double")
    ts = F.lit(0).cast("long") if rule.decode_scope else F.col("ts_ns")
    now = F.col("now_ns") if "now_ns" in columns else F.col("ts_ns")
    size = F.lit(0).cast("long") if rule.decode_scope or rule.scope == "session" else F.coalesce(F.col("length"), F.lit(0)).cast("long")
    out = events.where(match_column(rule, columns)).select(group_column(rule, columns).alias("grp"), F.col("seq").cast("long").alias("seq"), ts.alias("ts_ns"), now.alias("now_ns"), size.alias("bytes"), x.alias("x"))
    if rule.metric in ("distinct_count", "ratio"):
        out = out.where("x IS NOT NULL")
    return out


def stretched(events: DataFrame, window_ns: int | Column) -> DataFrame:
    """Adds stretch and ahead; an event near the end of a stretch is also there, ahead of the next one, as its past."""
    size = (max(window_ns, 1) if isinstance(window_ns, int) else F.greatest(window_ns, F.lit(1))) * WINDOWS_A_STRETCH
    own = floor_div("ts_ns", size)
    late = (F.col("ts_ns") - own * size) >= size - window_ns
    spots = F.when(late, F.array(F.struct(own.alias("s"), F.lit(False).alias("a")), F.struct((own + 1).alias("s"), F.lit(True).alias("a")))).otherwise(F.array(F.struct(own.alias("s"), F.lit(False).alias("a"))))
    return events.withColumn("_spot", F.explode(spots)).withColumn("stretch", F.col("_spot.s")).withColumn("ahead", F.col("_spot.a")).drop("_spot")


def window_values(events: DataFrame, window_ns: int, metric: str = "count", field_gt: float | None = None) -> DataFrame:
    """The metric at every event of (grp, seq, ts_ns, now_ns, bytes, x)."""
    cut = stretched(events, window_ns)
    by = Window.partitionBy("grp", "stretch")
    upto = by.orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = by.orderBy("ts_ns").rangeBetween(Window.unboundedPreceding, -window_ns - 1)
    diff = lambda agg: F.coalesce(agg.over(upto), F.lit(0)) - F.coalesce(agg.over(gone), F.lit(0))
    if metric == "distinct_count":
        # A value counts from an event on until it comes again or leaves the window; the value is begins less ends.
        again = Window.partitionBy("grp", "stretch", "x").orderBy("ts_ns", "seq")
        nxt, nseq = F.lead("ts_ns").over(again), F.lead("seq").over(again)
        seen = cut.withColumn("_nts", nxt).withColumn("_nseq", nseq)
        soon = F.col("_nts").isNotNull() & (F.col("_nts") <= F.col("ts_ns") + window_ns)
        begin = F.struct(F.col("ts_ns").alias("t"), F.col("seq").alias("q"), F.lit(1).alias("k"), F.lit(1).alias("d"))
        end = F.struct(F.when(soon, F.col("_nts")).otherwise(F.col("ts_ns") + window_ns + 1).alias("t"), F.when(soon, F.col("_nseq")).otherwise(F.lit(-(1 << 62))).alias("q"), F.lit(0).alias("k"), F.lit(-1).alias("d"))
        steps = seen.withColumn("_step", F.explode(F.array(begin, end)))
        running = F.sum("_step.d").over(by.orderBy("_step.t", "_step.q", "_step.k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = steps.withColumn("value", running.cast("double")).where("_step.k = 1").drop("_step", "_nts", "_nseq")
    elif metric == "ratio":
        hit = F.sum(F.when(F.col("x") > field_gt, 1).otherwise(0))
        out = cut.withColumn("value", diff(hit) / diff(F.count(F.lit(1))))
    else:
        out = cut.withColumn("value", diff(F.sum("bytes") if metric == "sum_bytes" else F.count(F.lit(1))).cast("double"))
    return out.where("NOT ahead").drop("stretch", "ahead")


#: Decode errors of a group are counted in stretches of this many packets.
ERRORS_A_STRETCH = 1 << 20


def running_counts(events: DataFrame) -> DataFrame:
    """The number of events of its group up to each event, by seq; equal ones count one after the other.

    A group is counted in stretches of packets, and stretches are added up as one row each, so no group is in one task.
    """
    cut = events.withColumn("_s", floor_div("seq", ERRORS_A_STRETCH))
    counts = cut.groupBy("grp", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("grp").alias("_g"), F.col("_s").alias("_gs"), (F.sum("_n").over(Window.partitionBy("grp").orderBy("_s")) - F.col("_n")).alias("_before"))
    own = cut.withColumn("_k", F.row_number().over(Window.partitionBy("grp", "_s").orderBy("seq")))
    return own.join(before, (F.col("grp") == F.col("_g")) & (F.col("_s") == F.col("_gs"))).withColumn("value", (F.col("_before") + F.col("_k")).cast("double")).drop("_s", "_k", "_g", "_gs", "_before")


#: Cooldowns in a stretch of a group's candidates.
COOLDOWNS_A_STRETCH = 64
_NEVER = -(1 << 63)


def _same(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows of a batch with equal values of ``names``."""
    new = np.zeros(len(batch), bool)
    for name in names:
        own = batch.column(name)
        new[1:] |= pc.fill_null(pc.not_equal(own[1:], own[:-1]), True).to_numpy(zero_copy_only=False)
    heads = [0, *np.flatnonzero(new).tolist(), len(batch)]
    return zip(heads[:-1], heads[1:], strict=True) if len(batch) else iter(())


def _stretch_exits(cooldown_ns: int):
    """For each stretch, until when a group is quiet after it: (first candidate at or after, quiet until) for all times it may be quiet until before."""

    def table(key: tuple, times: list[np.ndarray]) -> tuple:
        t = np.concatenate(times)
        later = np.searchsorted(t, t + cooldown_ns)
        zone = min(int(np.searchsorted(t, key[1] * cooldown_ns * COOLDOWNS_A_STRETCH + cooldown_ns)) + 1, len(t))
        at = np.arange(zone)
        while (more := later[at] < len(t)).any():  # as often as cooldowns fit at most
            at[more] = later[at[more]]
        return *key, t[:zone].astype("<i8").tobytes(), (t[at] + cooldown_ns).astype("<i8").tobytes()

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, out = None, [], []
        for batch in batches:
            now = batch.column("now_ns").to_numpy()
            for a, b in _same(batch, ["grp", "_stretch"]):
                own = batch.column("grp")[a].as_py(), batch.column("_stretch")[a].as_py()
                if key is not None and own != key:
                    out.append(table(key, times))
                    times = []
                key = own
                times.append(now[a:b])
            if len(out) > 1000:
                yield _rows(out)
                out = []
        if key is not None:
            out.append(table(key, times))
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["grp", "_stretch", "first", "exit"])

    return exits


def _stretch_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Until when a group is quiet when each of its stretches begins."""
    group, until, any_group = None, _NEVER, False
    for batch in batches:
        out = []
        for grp, first, exit_ in zip(*(batch.column(c).to_pylist() for c in ("grp", "first", "exit")), strict=True):
            if not any_group or grp != group:
                group, until, any_group = grp, _NEVER, True
            out.append(until)
            at = int(np.searchsorted(np.frombuffer(first, "<i8"), until))
            if at < len(exit_) // 8:
                until = int(np.frombuffer(exit_, "<i8", 1, 8 * at)[0])
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("_stretch"), pa.array(out, pa.int64())], ["grp", "_stretch", "_until"])


def _fired(cooldown_ns: int, names: list[str]):
    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        until = _NEVER
        for batch in batches:
            entry, now = batch.column("_until"), batch.column("now_ns").fill_null(_NEVER).to_numpy()
            begins = entry.is_valid().to_numpy(zero_copy_only=False)
            marks = entry.fill_null(0).to_numpy()
            picked = []
            heads = [0, *(np.flatnonzero(begins[1:]) + 1).tolist(), len(batch)]
            for a, b in zip(heads[:-1], heads[1:], strict=True):
                if begins[a]:
                    until, a = int(marks[a]), a + 1
                while (at := a + int(np.searchsorted(now[a:b], until))) < b:
                    picked.append(at)
                    until, a = int(now[at]) + cooldown_ns, at + 1
            yield batch.select(names).take(pa.array(picked, pa.int64()))

    return fired


def cooled(candidates: DataFrame, cooldown_ns: int) -> DataFrame:
    """The candidates that fire: the first of a group, and then the first at or after each one's cooldown.

    A group is cut into stretches of 64 cooldowns. A stretch tells until when its group is quiet after it, for each candidate that may be the first to
    fire in it (those of its first cooldown); the tables of a group, a row a stretch, pass in order and give each stretch what it begins with. So
    candidates of one group are spread over tasks, and only the times of one in about 64 of them pass one.
    """
    if cooldown_ns <= 0:
        return candidates
    candidates = materialize(candidates, "candidates")  # read twice
    names, width = candidates.columns, cooldown_ns * COOLDOWNS_A_STRETCH
    cut = candidates.withColumn("_stretch", floor_div("now_ns", width))
    times = cut.select(F.col("grp").cast("string").alias("grp"), "_stretch", "now_ns").repartition("grp", "_stretch").sortWithinPartitions("grp", "_stretch", "now_ns")
    tables = times.mapInArrow(_stretch_exits(cooldown_ns), "grp string, _stretch long, first binary, exit binary")
    entries = tables.repartition("grp").sortWithinPartitions("grp", "_stretch").mapInArrow(_stretch_entries, "grp string, _stretch long, _until long")
    rows = cut.withColumn("_until", F.lit(None).cast("long")).unionByName(entries.withColumn("grp", F.col("grp").cast(candidates.schema["grp"].dataType)), allowMissingColumns=True)
    order = ["grp", "_stretch", F.col("_until").isNull(), "now_ns", *(["_last"] if "_last" in names else []), "seq"]
    dealt = rows.repartition("grp", "_stretch").sortWithinPartitions(*order)
    return dealt.mapInArrow(_fired(cooldown_ns, names), candidates.schema)


def evidence(alerts: DataFrame, events: DataFrame, window_ns: int | Column, samples: int = 5) -> DataFrame:
    """Adds what the window of each alert held: first and last times, least and greatest seq, and sampled seqs.

    An equality join on (group, slice of a window); an alert looks into the slices its window touches, so a window of a busy group is spread over tasks.
    A window given as a column is of what both tables have.
    """
    width = slice_of(window_ns)
    one, own = ["grp", "seq", "now_ns"], ["grp", "seq", "now_ns", "_s"]
    keyed = alerts.select(*one, "ts_ns", (F.col("ts_ns") - window_ns).alias("_from"), width.alias("_w"))
    wide = keyed.withColumn("_s", F.explode(F.sequence(floor_div("_from", F.col("_w")), floor_div("ts_ns", F.col("_w")))))
    past = events.select(F.col("grp").alias("_g"), F.col("seq").alias("_q"), F.col("ts_ns").alias("_t"), floor_div("ts_ns", width).alias("_es"))
    inside = (F.col("_t") >= F.col("_from")) & ((F.col("_t") < F.col("ts_ns")) | ((F.col("_t") == F.col("ts_ns")) & (F.col("_q") <= F.col("seq"))))
    held = wide.join(past, (F.col("grp") == F.col("_g")) & (F.col("_s") == F.col("_es")) & inside).select(*own, "_t", "_q")
    # Slices are in order of time, so a packet's place in the window is its place in its slice behind those before. A row a slice is what passes here.
    slices = held.groupBy(*own).agg(F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.min("_q").alias("_q0"), F.max("_q").alias("_q1"), F.count(F.lit(1)).alias("_n"))
    all_of = Window.partitionBy(*one)
    placed = slices.withColumn("_before", F.sum("_n").over(all_of.orderBy("_s")) - F.col("_n")).withColumn("_all", F.sum("_n").over(all_of))
    pick = F.array_distinct(F.array(*[F.floor((F.col("_all") - 1) * k / (samples - 1)) for k in range(samples)]))
    wanted = placed.withColumn("_p", F.explode(pick)).where("_p >= _before AND _p < _before + _n").select(*own, (F.col("_p") - F.col("_before") + 1).cast("int").alias("_i"))
    ranked = held.withColumn("_i", F.row_number().over(Window.partitionBy(*own).orderBy("_t", "_q")))
    picked = ranked.join(wanted, [*own, "_i"]).groupBy(*one).agg(F.array_sort(F.collect_set("_q")).alias("sample_packets"))
    found = slices.groupBy(*one).agg(F.min("_t0").alias("first_ts"), F.max("_t1").alias("last_ts"), F.min("_q0").alias("first_packet"), F.max("_q1").alias("last_packet"))
    return alerts.join(found, one).join(picked, one)


def in_arrival_order(events: DataFrame) -> DataFrame:
    """Events (grp, seq, ts_ns) as a window that is fed by arrival sees them: ``ts_ns`` and ``now_ns`` become the group's greatest time so far, ``own_ts`` stays.

    A window fed by arrival drops events from its front, in the order they came, while they are older than the greatest time less the window. So what it
    holds at an event begins with the first one whose greatest time so far is within the window, and late events behind that one stay in. By the greatest time so
    far, which never falls, that is an ordinary window. Maxima are taken over stretches of packets, and of a group one row a stretch passes a task.
    """
    cut = events.withColumn("_s", floor_div("seq", ERRORS_A_STRETCH))
    tops = cut.groupBy("grp", "_s").agg(F.max("ts_ns").alias("_top"))
    before = F.max("_top").over(Window.partitionBy("grp").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    heads = tops.select(F.col("grp").alias("_g"), F.col("_s").alias("_gs"), before.alias("_before"))
    run = F.max("ts_ns").over(Window.partitionBy("grp", "_s").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = cut.withColumn("_run", run).join(heads, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_gs")))
    top = F.greatest("_run", "_before")  # which ignores nulls
    return joined.withColumn("own_ts", F.col("ts_ns")).withColumn("ts_ns", top).withColumn("now_ns", F.col("ts_ns")).drop("_s", "_g", "_gs", "_before", "_run")


def evaluate(events: DataFrame, rule: Rule, flush: bool = False, with_evidence: bool = False, compat: bool = False) -> DataFrame:
    """Alerts of one rule: (rule_id, severity, grp, seq, ts_ns, now_ns, value), and evidence if asked for.

    ``flush`` looks at each group's last window once more when the capture ends, with the capture's last time as
    now: a window that is still over the threshold fires again if its cooldown is over. Decode errors have no time of
    their own (ts 0), so their windows never slide and count all there is.

    ``compat`` takes events in the order they arrived (by seq) where a capture's times are out of order, see :func:`in_arrival_order`; now is the group's
    greatest time so far then. Where times are in order nothing changes.
    """
    own = matched_events(events, rule)
    compat = compat and not rule.decode_scope
    if compat:
        own = in_arrival_order(own)
    kept = ["own_ts"] if compat else []
    values = running_counts(own) if rule.decode_scope and rule.metric == "count" else window_values(own, rule.window_ns, rule.metric, rule.field_gt)
    over = values.where(threshold_met(F.col("value"), rule.operator, rule.value)).select("grp", "seq", "ts_ns", "now_ns", "value", *kept)
    if flush:
        final = events.agg(F.max("now_ns" if "now_ns" in events.columns else "ts_ns").alias("_final"))
        last = values.groupBy("grp").agg(F.max(F.struct("ts_ns", "seq", "value", *kept)).alias("l")).select("grp", *[F.col(f"l.{c}").alias(c) for c in ("seq", "ts_ns", "value", *kept)])
        again = last.where(threshold_met(F.col("value"), rule.operator, rule.value)).crossJoin(final).select("grp", "seq", "ts_ns", F.col("_final").alias("now_ns"), "value", *kept)  # one number
        over = over.withColumn("_last", F.lit(0)).unionByName(again.withColumn("_last", F.lit(1)))
    fired = cooled(over, rule.cooldown_ns)
    fired = fired.drop("_last") if flush else fired
    if with_evidence:
        fired = evidence(fired, own, rule.window_ns)
    if compat:
        fired = fired.withColumn("ts_ns", F.col("own_ts")).drop("own_ts")
        fired = fired.withColumn("last_ts", F.col("ts_ns")) if with_evidence else fired
    return fired.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.hash).alias("rule_hash"), "*")
