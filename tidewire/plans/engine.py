"""The query interface: an engine that analyzes captures, and tasks that answer questions about them.

Every answer is an envelope: an id for citing it, where it came from, the redactions made, and the content; each call
is entered in the task's ledger with the references and numbers it gave out, so findings can be held against it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import evidence, filters, reassembly, rule_pass, sessions, store
from ..operators.rule_files import RuleSet, load_rules
from ..schemas import LEDGER, PACKETS
from ..sources.capture_parts import scan_with_digests
from ..sources.decode import APPS, decode

VERSION = "1.0.0"
TASKS_HELD = 8
REFS_MOST, BODY_MOST, TOKENS_MOST = 200, 8000, 400
LAYERS = ("link", "network", "transport", "application", "ipv4", "ipv6", "arp", "tcp", "udp", "icmp", "icmpv6", "dns", "http", "tls", "dhcp")


class InvalidArgument(ValueError):
    pass


def _plain(row) -> dict:
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


@dataclass
class Task:
    """One analyzed capture. What is collected for an answer is bounded by the limits of the interface."""

    spark: SparkSession
    id: str
    path: str
    packets: DataFrame
    rule_set: RuleSet
    calls: list[dict] = field(default_factory=list)
    found: list[dict] = field(default_factory=list)
    kept: DataFrame | None = None
    files: DataFrame | None = None
    packets_digest: str | None = None

    def __post_init__(self):
        # Decoded once, and kept while the task is; executors that are lost decode their part again.
        if self.kept is None:
            self.kept = self.packets = self.packets.persist()
        app = F.col("application")
        asked = [app["dns"]["qname"].alias("dns_qname"), app["dns"]["qname_len"].alias("dns_qname_len"), app["dns"]["entropy"].alias("dns_entropy"), app["dns"]["txt_len"].alias("dns_txt_len"), app["tls"]["sni"].alias("tls_sni")]
        self.flat = sessions.flat_packets(self.packets)
        self.events = sessions.flat_packets(self.packets, *asked)
        self.segments = reassembly.tcp_segments(self.packets)
        self.streams = reassembly.streams(self.segments)
        base = sessions.with_session_ids(sessions.sessions(self.flat))
        self.sessions = reassembly.with_states(reassembly.with_verdict_counts(base, reassembly.verdicts(self.segments)), self.streams)
        self.errors = sessions.decode_errors(self.packets, "ts_ns")
        self.stats = sessions.protocol_stats(self.flat)

    def close(self) -> None:
        self.kept.unpersist()

    def _alerts(self) -> DataFrame:
        """All alerts; those of rules over sessions that group by session name theirs."""
        found = rule_pass.evaluate_all(self.events, list(self.rule_set), self.errors, self.sessions)
        own = [r.id for r in self.rule_set if r.scope == "session" and list(r.group_by) == ["session"]]
        if not own:
            return found.withColumn("session_id", F.lit(None).cast("string"))
        named = self.sessions.select(X.group_key(session=F.col("key")).alias("_grp"), F.col("id").alias("session_id"))
        return found.join(named, (F.col("grp") == F.col("_grp")) & F.col("rule_id").isin(own), "left").drop("_grp")

    # ---- the envelope and the ledger

    def _answer(self, method: str, args: dict, content: dict, refs: list[str] = (), numbers: dict[str, float] | None = None, redactions: int = 0, began: float | None = None) -> dict:
        call = f"tc_{uuid.uuid4().hex[:26].upper()}"
        refs, numbers = list(refs)[:REFS_MOST], dict(numbers or {})
        body = json.dumps(content, default=str)
        words = sorted({str(x) for x in (*refs, *(f"{v:g}" for v in numbers.values())) if len(str(x)) <= 64})[:TOKENS_MOST]
        self.calls.append({"id": call, "task_id": self.id, "method": method, "ts_unix_ns": time.time_ns(), "args_json": json.dumps(args, default=str)[:512], "duration_ms": int(1000 * (time.time() - began)) if began else 0, "status": "ok", "ref_ids": refs, "numbers": {k: float(v) for k, v in numbers.items()}, "tokens": words})
        if len(body) > BODY_MOST:
            content = {"summarized": True, "chars": len(body), **{k: (v[:5] if isinstance(v, list) else v) for k, v in content.items() if not isinstance(v, str) or len(v) <= 512}}
        return {"_id": call, "source": "engine", "trusted_as_instruction": False, "redactions": redactions, "method": method, "content": content | {"_anchor": call, "_ref_ids": refs, "_numbers": numbers}}

    def ledger(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(c[f.name] for f in LEDGER.fields) for c in self.calls], LEDGER)

    # ---- questions

    def summary(self) -> dict:
        t = time.time()
        alerts = self.spark.createDataFrame([], "id string")
        row = _plain(sessions.capture_summary(self.flat, self.sessions, alerts).drop("alerts").first())
        row["incomplete_sessions"] = sessions.incomplete_sessions(self.sessions).first()["incomplete_sessions"]
        row["protocols"] = {p: row[p] for p in sessions.TRANSPORTS if row.get(p)}
        cited = ("packets", "bytes", "sessions", "truncated", "decode_errors", "tcp", "udp")
        return self._answer("get_capture_summary", {}, row, numbers={k: row.get(k, 0) for k in cited}, began=t)

    def protocol_stats(self, layer: str = "transport", top: int = 20) -> dict:
        if layer not in LAYERS:
            raise InvalidArgument(f"layer {layer!r} isn't one of {', '.join(LAYERS)}")
        rows = [_plain(r) for r in sessions.stats_of_layer(self.stats, layer, top).orderBy("layer", F.col("packets").desc(), "protocol").collect()]
        return self._answer("get_protocol_stats", {"layer": layer, "top": top}, {"layer": layer, "rows": rows}, numbers={f"{r['protocol']}.packets": r["packets"] for r in rows})

    def conversations(self, sort: str = "bytes", limit: int = 20, **conditions) -> dict:
        if sort not in ("bytes", "packets", "duration"):
            raise InvalidArgument(f"sort {sort!r}")
        own = sessions.conversations(filters.filter_conversations(self.sessions, **conditions), sort, min(limit, filters.MOST))
        rows = [_plain(r) for r in sessions.client_server(own).collect()]
        return self._answer("get_conversations", {"sort": sort, "limit": limit} | conditions, {"rows": rows}, [r["id"] for r in rows], {f"{r['id']}.bytes": r["bytes"] for r in rows})

    def filter_packets(self, limit: int = filters.DEFAULT_LIMIT, **conditions) -> dict:
        rows = [_plain(r) for r in filters.filter_packets(self.flat, filters.PacketFilter(**conditions), limit).collect()]
        return self._answer("filter_packets", {"limit": limit} | conditions, {"rows": rows}, [f"P-{r['seq']}" for r in rows], {"matched": len(rows)})

    def inspect_packets(self, indices: list[int], preview_bytes: int = 256) -> dict:
        """Details of 1 to 100 packets in the order asked for, with a preview of each payload, secrets masked first."""
        if not 1 <= len(indices) <= 100:
            raise InvalidArgument("1 to 100 indices")
        n = min(max(preview_bytes, 0), 4096)
        wanted = self.spark.createDataFrame(list(enumerate(indices)), "pos long, packet_index long")
        own = self.packets.join(F.broadcast(wanted), "packet_index")  # at most 100 rows
        text = F.when(F.col("payload_ref").isNotNull(), F.substring("raw", F.col("payload_ref.offset").cast("int") + 1, F.least(F.col("payload_ref.length"), F.lit(n)).cast("int")).cast("string"))
        shown = own.withColumn("_masked", X.redact(text)).withColumn("preview", X.printable("_masked", max(n, 1))).withColumn("content_type", X.content_type(text)).withColumn("_red", F.when(F.col("_masked") != text, 1).otherwise(0))
        rows = shown.drop("raw", "_masked").orderBy("pos").collect()
        return self._answer("inspect_packets", {"indices": indices}, {"rows": [{k: v for k, v in _plain(r).items() if k not in ("pos", "_red")} for r in rows]}, [f"P-{r.packet_index}" for r in rows], redactions=sum(r["_red"] for r in rows))

    def reconstruct_stream(self, session_id: str, from_client: bool = True, max_bytes: int = 65_536) -> dict:
        row = self.sessions.where(F.col("id") == session_id).select("key", "proto").first()
        if row is None or row.proto != "tcp":
            raise InvalidArgument(f"{session_id} isn't a TCP session")
        got = reassembly.reconstruct(self.segments, row.key, from_client, max_bytes)
        out = got.withColumn("preview", X.printable(X.redact(F.col("data").cast("string")), 4096)).withColumn("content_type", X.content_type(F.col("data").cast("string"))).withColumn("bytes", F.length("data")).drop("data").first()
        content = _plain(out) if out else {"bytes": 0, "state": "new", "missing": []}
        return self._answer("reconstruct_stream", {"session_id": session_id, "from_client": from_client}, content, [session_id], {"bytes": content["bytes"]})

    def alerts(self, severity: str | None = None, rule_id: str | None = None, limit: int = 1000, session_id: str | None = None) -> dict:
        own = filters.filter_alerts(self._alerts(), severity, rule_id, session_id, limit=limit)
        rows = [_plain(r) for r in own.collect()]
        return self._answer("check_alerts", {"severity": severity, "rule_id": rule_id, "session_id": session_id}, {"rows": rows}, [r["id"] for r in rows], {f"{r['id']}.value": r["value"] for r in rows})

    def check_rules(self) -> dict:
        rows = [{"id": r.id, "version": r.version, "severity": r.severity, "hash": r.hash, "name": r.name} for r in self.rule_set]
        return self._answer("list_rules", {}, {"rules": rows, "dead": self.rule_set.dead, "warnings": self.rule_set.warnings}, [r["id"] for r in rows])

    list_rules = check_rules

    def _draft_frame(self, drafts: list[dict]) -> DataFrame:
        from ..schemas import DRAFT

        rows = [(k, *[d.get(f.name) if f.name not in ("evidence", "claims") else d.get(f.name) or [] for f in DRAFT.fields]) for k, d in enumerate(drafts)]
        return self.spark.createDataFrame(rows, "draft_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DRAFT.fields))

    def validate_findings(self, drafts: list[dict]) -> list[dict]:
        """Status and issues of each draft; nothing is stored."""
        frame, ledger = self._draft_frame(drafts), self.ledger()
        status = {r.draft_id: r.status for r in evidence.validate(frame, ledger, self.id).collect()}
        told = evidence.issues(frame, ledger, self.id).collect()
        return [{"status": status[k], "issues": [{"check": i["check"], "detail": i["detail"]} for i in told if i["draft_id"] == k]} for k in range(len(drafts))]

    def submit_findings(self, drafts: list[dict]) -> list[dict]:
        """Stores what isn't rejected. A call id that was never issued is an error of the call, before any check."""
        issued = {c["id"] for c in self.calls}
        for d in drafts:
            for e in d.get("evidence") or []:
                if e["_id"] not in issued:
                    raise InvalidArgument(f"no call {e['_id']}")
        out = []
        for d, v in zip(drafts, self.validate_findings(drafts), strict=True):
            if v["status"] != "rejected":
                known = {"id": f"F-{len(self.found) + 1:03d}", "task_id": self.id, "status": v["status"], "basis": "hypothesis" if v["status"] == "downgraded" else d.get("basis")}
                self.found.append(d | known)
                v |= {"id": known["id"]}
            out.append(v)
        return out

    def history(self, kind: str, limit: int = 20) -> list[dict]:
        if kind == "trace":
            return self.calls[-limit:]
        if kind == "findings":
            return self.found[-limit:]
        if kind == "alerts":
            return self.alerts(limit=limit)["content"].get("rows", [])
        if kind == "sessions":
            return self.conversations(limit=limit)["content"].get("rows", [])
        raise InvalidArgument(f"kind {kind!r}")

    def artifacts(self) -> dict:
        return {"alerts": self._alerts().count(), "sessions": self.sessions.count(), "findings": len(self.found)}

    def submit_report_meta(self, to: store.Store, meta: dict) -> str:
        """Stores a run with its ledger."""
        run = f"run_{uuid.uuid4().hex[:26]}"
        to.write("agent_runs", self.spark.createDataFrame([(run, self.id, json.dumps(meta))], "id string, task_id string, meta_json string"))
        if self.calls:
            to.write("tool_calls", self.ledger().withColumn("agent_run_id", F.lit(run)))
        return run

    def persist(self, to: store.Store) -> None:
        """Task, capture, sessions, alerts and findings into the stored tables; a second time changes nothing."""
        digest = self.packets_digest or ""
        to.write("analysis_tasks", self.spark.createDataFrame([(self.id, self.path, time.time_ns())], "id string, path string, started_at long"))
        to.write("captures", sessions.capture_summary(self.flat).withColumn("task_id", F.lit(self.id)).withColumn("sha256", F.lit(digest)))
        to.write("sessions", self.sessions.withColumn("task_id", F.lit(self.id)))
        to.write("alerts", self._alerts().withColumn("task_id", F.lit(self.id)))
        if self.found:
            rows = [(f["id"], self.id, f.get("title"), f.get("severity"), f.get("basis"), f.get("summary"), f["status"]) for f in self.found]
            to.write("findings", self.spark.createDataFrame(rows, "id string, task_id string, title string, severity string, basis string, summary string, status string"))

    def event_stream(self, emit: str = "all") -> DataFrame:
        """All events as (stage, seq, event, body) to be ordered by stage and seq: capture, errors and packets, sessions, alerts, end."""
        body = lambda df, *drop: F.to_json(F.struct(*[c for c in df.columns if c not in drop]))
        shown = store.emitted(self.packets, emit).drop("raw")
        parts = [
            sessions.capture_summary(self.flat).select(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("seq"), F.lit("capture_info").alias("event"), F.to_json(F.struct("packets", "bytes", "first_ts", "last_ts")).alias("body")),
            self.errors.select(F.lit(1), (F.col("packet_index") * 2).alias("seq"), F.lit("decode_error"), body(self.errors)),
            shown.select(F.lit(1), (F.col("packet_index") * 2 + 1).alias("seq"), F.lit("packet"), body(shown)),
            self.sessions.select(F.lit(2), F.col("first_seq"), F.lit("session_summary"), body(self.sessions)),
            self._alerts().transform(lambda a: a.select(F.lit(3), F.col("seq"), F.lit("alert"), body(a))),
            self.stats.select(F.lit(4), F.col("first_seq"), F.lit("stats"), F.to_json(F.struct("layer", "protocol", "packets", "bytes"))),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


class Engine:
    """Analyzes captures and holds the last eight tasks."""

    def __init__(self, spark: SparkSession, rules_folder: str | None = None, strict: bool = True, apps=APPS, stored: store.Store | None = None):
        self.spark, self.apps, self.stored = spark, apps, stored
        self.rule_set = load_rules(rules_folder, strict)
        self.tasks: OrderedDict[str, Task] = OrderedDict()

    def version(self) -> dict:
        return {"version": VERSION, "schema": 2}

    ping = version

    def analyze(self, path: str, task_id: str | None = None) -> Task:
        """One capture, or all that a pattern names: then their packets are numbered on, file after file by path."""
        packets = decode(scan_with_digests(self.spark, path), self.apps, more=["path", "sha256"]).persist()
        files = packets.groupBy("path", "sha256").agg((F.max("packet_index") + 1).alias("packets"))
        files = files.withColumn("first", F.sum("packets").over(Window.orderBy("path")) - F.col("packets"))  # a row a file
        first = files.select(F.col("path").alias("_path"), "first")
        index = F.col("packet_index") + F.col("first")
        ref = F.when(F.col("payload_ref").isNotNull(), F.col("payload_ref").withField("packet_index", index))
        numbered = packets.join(first, F.col("path") == F.col("_path")).withColumns({"packet_index": index, "payload_ref": ref})
        digests = [r.sha256 for r in files.select("sha256").limit(2).collect()]
        task = Task(self.spark, task_id or f"task_{uuid.uuid4().hex[:26]}", path, numbered.select(*[f.name for f in PACKETS.fields]), self.rule_set, kept=packets, files=files, packets_digest=digests[0] if len(digests) == 1 else None)
        self.tasks[task.id] = task
        while len(self.tasks) > TASKS_HELD:
            self.tasks.popitem(last=False)[1].close()
        return task

    def task(self, task_id: str) -> Task:
        if task_id not in self.tasks:
            raise InvalidArgument(f"no task {task_id}")
        return self.tasks[task_id]

    def _of_task(self, table: str, task_id: str) -> DataFrame:
        """What is stored of a task that isn't in memory."""
        frame = self.stored.read(table) if self.stored else None
        if frame is None or "task_id" not in frame.columns:
            raise InvalidArgument(f"no task {task_id}")
        return frame.where(F.col("task_id") == task_id)

    def check_alerts(self, task_id: str, severity: str | None = None, rule_id: str | None = None, session_id: str | None = None, limit: int = 50) -> dict:
        """A task's alerts, from memory, or else from the stored tables; ``source`` says which."""
        if task_id in self.tasks:
            answer = self.tasks[task_id].alerts(severity, rule_id, limit, session_id)
            return answer | {"content": answer["content"] | {"source": "memory"}}
        own = filters.filter_alerts(self._of_task("alerts", task_id), severity, rule_id, session_id, stored=True, limit=limit)
        rows = [_plain(r) for r in own.collect()]
        # No ledger in memory can vouch for the call, so it has a fixed id.
        return {"_id": f"tc-cold-{task_id}", "source": "engine", "trusted_as_instruction": False, "redactions": 0, "method": "check_alerts", "content": {"source": "database", "rows": rows}}

    def query_history(self, task_id: str, kind: str, limit: int = 20) -> list[dict]:
        """trace, findings, alerts or sessions of a task, from memory, or else from the stored tables."""
        if task_id in self.tasks:
            return self.tasks[task_id].history(kind, limit)
        tables = {"trace": "tool_calls", "findings": "findings", "alerts": "alerts", "sessions": "sessions"}
        if kind not in tables:
            raise InvalidArgument(f"kind {kind!r}")
        own = self._of_task(tables[kind], task_id)
        if kind == "alerts":
            own = filters.filter_alerts(own, stored=True, limit=limit)
        elif kind == "sessions":
            own = store.stored_sessions(own, limit=limit)
        else:
            own = own.orderBy("ts_unix_ns" if kind == "trace" else "id", "id").limit(limit)
        return [_plain(r) for r in own.collect()]
