"""A Markdown report of a task, rendered from bounded answers only."""

from __future__ import annotations

import re

from ..functions.scalars import TOKEN_PATTERN

#: Fixed value: what stands for a token that no call gave out.
UNVERIFIED = "[unverified by engine]"
SECTIONS = ("Summary", "Capture", "Protocols", "Conversations", "Alerts", "Findings", "Evidence", "Rules", "Trace")


def _table(rows: list[dict], columns: list[str]) -> str:
    if not rows:
        return "_none_\n"
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join(cell(r.get(c, "")) for c in columns) + " |" for r in rows]]) + "\n"


def illegal(text: str, legal: set[str]) -> list[str]:
    """Tokens of a text that the engine never gave out."""
    return [t for t in re.findall(TOKEN_PATTERN, text) if t not in legal]


def marked(text: str, legal: set[str]) -> tuple[str, int]:
    """The text with a marker in place of each token that the engine never gave out, and their number."""
    bad = illegal(text, legal)
    return re.sub(TOKEN_PATTERN, lambda m: m[0] if m[0] in legal else UNVERIFIED, text), len(bad)


def render(task, executive_summary: str = "") -> str:
    """Nine sections. An executive summary may only name what a call gave out; else it is refused. What findings name beyond that is marked and counted."""
    summary = task.summary()["content"]
    parts = {
        "Capture": _table([summary], ["packets", "bytes", "sessions", "truncated", "decode_errors", "duration_s"]),
        "Protocols": _table(task.protocol_stats("transport")["content"].get("rows", []), ["layer", "protocol", "packets", "bytes"]),
        "Conversations": _table(task.conversations()["content"].get("rows", []), ["id", "proto", "client_ip", "client_port", "server_ip", "server_port", "packets", "bytes", "state"]),
        "Alerts": _table(task.alerts()["content"].get("rows", []), ["id", "rule_id", "severity", "grp", "value"]),
        "Findings": _table(task.found, ["id", "title", "severity", "basis", "status"]),
        "Evidence": _table([{"call": e["_id"], "method": e.get("method"), "ref": e.get("ref_id")} for f in task.found for e in f.get("evidence") or []], ["call", "method", "ref"]),
        "Rules": _table(task.check_rules()["content"].get("rules", []), ["id", "version", "severity", "hash"]),
    }
    legal = {t for c in task.calls for t in c["tokens"]} | {r for c in task.calls for r in c["ref_ids"]}
    if bad := illegal(executive_summary, legal):
        raise ValueError(f"the summary names what no call gave out: {', '.join(bad)}")
    parts["Summary"] = executive_summary or "_none_"
    parts["Trace"] = _table(task.calls, ["id", "method", "status"])
    given = "\n".join(parts[s] for s in SECTIONS if s not in ("Findings", "Evidence"))
    legal |= {task.id, *re.findall(TOKEN_PATTERN, given), *(str(f.get("id")) for f in task.found)}
    unverified = 0
    for section in ("Findings", "Evidence"):
        parts[section], n = marked(parts[section], legal)
        unverified += n
    warning = f"UNVERIFIED CONTENT: {unverified} items\n\n" if unverified else ""
    return f"# Report on {task.id}\n\n{warning}" + "\n".join(f"## {s}\n\n{parts[s]}\n" for s in SECTIONS)
