"""Rule files: YAML into checked rules. Unknown keys are errors, and so is what the checks S1 to S10 find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from dataclasses import field as made
from pathlib import Path

import yaml

#: Fixed values of the rule language.
WINDOWS = {"1s": 1, "5s": 5, "10s": 10, "30s": 30, "1m": 60, "5m": 300}
FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "captured_len", "dns.qname", "dns.qname_len", "dns.entropy", "dns.txt_len", "tls.sni")
FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
GROUP_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "session", "decode_code")
SCOPES = ("packet", "session")
METRICS = ("count", "distinct_count", "sum_bytes", "ratio")
OPERATORS = ("gt", "gte", "lt", "lte", "eq", "neq")
SEVERITIES = ("info", "low", "medium", "high", "critical")
RULE_ID = re.compile(r"[A-Z][A-Z0-9]*(-[A-Z0-9]+)*-[0-9]{3}")


#: A folder of rules beside the built-in ones, which shows a ratio, sessions and distinct names: ``load_rules(EXAMPLES)``.
EXAMPLES = Path(__file__).parent / "example_rules"


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    window_ns: int
    operator: str
    value: float
    metric: str = "count"
    field: str | None = None
    field_gt: float | None = None
    group_by: tuple[str, ...] = ("src_ip",)
    cooldown_ns: int = 60_000_000_000
    scope: str = "packet"
    match: dict = made(default_factory=dict, hash=False)
    version: int = 1
    name: str = ""
    severity: str = "info"
    description: str = ""
    tags: tuple[str, ...] = ()
    hash: str = ""

    @property
    def decode_scope(self) -> bool:
        """Rules with a decode condition look at decode errors, not at packets."""
        return bool({"decode_layer", "decode_code"} & set(self.match))


def _only(given: dict, known: Iterable[str], where: str) -> dict:
    if not isinstance(given, dict):
        raise RuleError(f"{where} must be a mapping")
    if unknown := sorted(set(given) - set(known)):
        raise RuleError(f"{where}: unknown keys {', '.join(unknown)}")
    return given


def _port(spec, where: str) -> None:
    if isinstance(spec, int) and not isinstance(spec, bool):
        return
    _only(spec, ("gte", "lte", "eq", "in"), where)


def content_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def parse_rule(text: str) -> tuple[Rule, dict]:
    """The rule of a YAML text and the mapping it came from; raises on form, not on sense."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RuleError(f"not YAML: {e}") from e
    _only(raw, ("id", "version", "name", "severity", "scope", "match", "threshold", "dedupe", "description", "tags", "enabled"), "rule")
    for key in ("id", "threshold"):
        if key not in raw:
            raise RuleError(f"{key} is missing")
    match = dict(_only(raw.get("match") or {}, ("protocol", "flags", "src_port", "dst_port", "any_port", "either_port", "dns", "decode_layer", "decode_code"), "match"))
    if "either_port" in match:
        match["any_port"] = match.pop("either_port")
    for key in ("src_port", "dst_port", "any_port"):
        if key in match:
            _port(match[key], f"match.{key}")
    _only(match.get("flags") or {}, ("contains", "excludes"), "match.flags")
    _only(match.get("dns") or {}, ("qname_len_gt", "txt_len_gt", "entropy_gt"), "match.dns")
    t = _only(raw["threshold"], ("metric", "field", "field_gt", "group_by", "window", "operator", "value"), "threshold")
    for key in ("metric", "window", "operator", "value", "group_by"):
        if key not in t:
            raise RuleError(f"threshold.{key} is missing")
    d = _only(raw.get("dedupe") or {}, ("per_group_cooldown",), "dedupe")
    for value, known, where in ((t["metric"], METRICS, "metric"), (t["operator"], OPERATORS, "operator"), (raw.get("scope", "packet"), SCOPES, "scope"), (raw.get("severity", "info"), SEVERITIES, "severity")):
        if value not in known:
            raise RuleError(f"{where} {value!r} isn't one of {', '.join(known)}")
    if bad := [g for g in t["group_by"] if g not in GROUP_FIELDS]:
        raise RuleError(f"group_by {', '.join(map(str, bad))} isn't known")
    rule = Rule(
        id=str(raw["id"]), version=int(raw.get("version", 1)), name=raw.get("name") or "", severity=raw.get("severity", "info"), scope=raw.get("scope", "packet"), match=match,
        metric=t["metric"], field=t.get("field"), field_gt=t.get("field_gt"), group_by=tuple(t["group_by"]), operator=t["operator"], value=float(t["value"]),
        window_ns=WINDOWS.get(t["window"], 0) * 1_000_000_000, cooldown_ns=WINDOWS.get(d.get("per_group_cooldown", "1m"), 0) * 1_000_000_000,
        description=raw.get("description") or "", tags=tuple(raw.get("tags") or ()), hash=content_hash(text),
    )
    return rule, raw


def _fits_53(spec) -> bool:
    if isinstance(spec, int):
        return spec == 53
    return bool(spec) and spec.get("gte", 0) <= 53 <= spec.get("lte", 65535) and spec.get("eq", 53) == 53 and 53 in spec.get("in", [53])


def check_rule(rule: Rule, raw: dict, stem: str | None = None, seen: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(errors, warnings), each with the number of its check."""
    errors, warnings, match = [], [], rule.match
    if not RULE_ID.fullmatch(rule.id):
        errors.append(f"S1: id {rule.id!r} doesn't have the form of a rule id")
    if rule.id in seen:
        errors.append(f"S1: id {rule.id!r} is taken")
    if stem is not None and stem != rule.id:
        errors.append(f"S1: file {stem!r} isn't named after its rule {rule.id!r}")
    if rule.metric != "count" and rule.field is None:
        errors.append(f"S2: {rule.metric} needs a field")
    if rule.metric == "ratio" and rule.field_gt is None:
        errors.append("S2: ratio needs field_gt")
    if rule.field is not None and rule.field not in FIELDS:
        errors.append(f"S3: field {rule.field!r} isn't one of {', '.join(FIELDS)}")
    for name, value in (("window", raw["threshold"]["window"]), ("per_group_cooldown", (raw.get("dedupe") or {}).get("per_group_cooldown", "1m"))):
        if value not in WINDOWS:
            errors.append(f"S4: {name} {value!r} isn't one of {', '.join(WINDOWS)}")
    if "flags" in match:
        if rule.scope != "packet" or match.get("protocol") != "tcp":
            errors.append("S5: flags need scope packet and protocol tcp")
        for f in (*(match["flags"].get("contains") or ()), *(match["flags"].get("excludes") or ())):
            if f not in FLAGS:
                errors.append(f"S5: flag {f!r} isn't known")
    if "dns" in match and not (match.get("protocol") == "udp" and _fits_53(match.get("dst_port"))):
        errors.append("S6: dns conditions need protocol udp and dst_port 53")
    if rule.metric == "ratio":
        if not 0 < rule.value <= 1:
            errors.append(f"S7: a ratio of {rule.value} isn't in (0, 1]")
        if rule.operator not in ("gt", "gte"):
            errors.append("S7: a ratio is compared by gt or gte")
    if not rule.description.strip():
        warnings.append("S8: there is no description")
    if len(rule.tags) > 8:
        warnings.append(f"S8: {len(rule.tags)} tags are more than 8")
    if not rule.group_by:
        errors.append("S9: group_by is empty")
    if "any_port" in match:
        if match.get("protocol") not in ("tcp", "udp"):
            errors.append("S10: any_port needs protocol tcp or udp")
        if "src_port" in match or "dst_port" in match:
            warnings.append("S10: any_port beside src_port or dst_port says nothing new")
    return errors, warnings


@dataclass
class RuleSet:
    """Rules by id, in order; a file's rule takes the place of a built-in one with its id."""

    rules: dict[str, Rule] = made(default_factory=dict)
    dead: list[tuple[str, str]] = made(default_factory=list)
    warnings: list[tuple[str, str]] = made(default_factory=list)

    def __iter__(self):
        return iter(self.rules[k] for k in sorted(self.rules))

    def __len__(self) -> int:
        return len(self.rules)


def load_rules(folder: str | Path | None = None, strict: bool = True, builtin: bool = True) -> RuleSet:
    """Built-in rules and those of a folder (*.yaml, *.yml, by name). Strict raises at the first bad file; else it is put aside."""
    out, own = RuleSet(), set()
    sources = [(p, True) for p in sorted((Path(__file__).parent / "builtin_rules").glob("*.yaml"))] if builtin else []
    if folder is not None:
        sources += [(p, False) for p in sorted([*Path(folder).glob("*.yaml"), *Path(folder).glob("*.yml")])]
    for path, inner in sources:
        try:
            rule, raw = parse_rule(path.read_text(encoding="utf-8"))
            errors, warnings = check_rule(rule, raw, path.stem, () if inner else own)
            if errors:
                raise RuleError("; ".join(errors))
        except (RuleError, OSError, UnicodeDecodeError) as e:
            if strict:
                raise RuleError(f"{path.name}: {e}") from e
            out.dead.append((path.name, str(e)))
            continue
        out.warnings += [(path.name, w) for w in warnings]
        out.rules[rule.id] = rule
        if not inner:
            own.add(rule.id)
    return out
