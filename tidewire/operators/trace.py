"""The trace of an agent's run: counters, evaluation metrics, and findings beside the calls they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("llm_ms", "tool_ms", "tokens_in", "tokens_out", "cost")


def counters(trace: DataFrame, by: str = "run_id") -> DataFrame:
    """Sums of what each run took, and its number of steps; a missing number counts as 0."""
    return trace.groupBy(by).agg(F.count(F.lit(1)).alias("steps"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c in trace.columns])


def evaluation(cases: DataFrame) -> DataFrame:
    """For each case (expected, actual: arrays of tool names; valid, findings): the share of expected tools that were
    used, and the share of findings that hold. Nothing expected is met in full."""
    met = F.size(F.array_intersect("expected", "actual"))
    return cases.select(
        "case_id",
        F.when(F.size(F.array_distinct("expected")) == 0, 1.0).otherwise(met / F.size(F.array_distinct("expected"))).alias("path_match"),
        F.when(F.col("findings") == 0, 1.0).otherwise(F.col("valid") / F.col("findings")).alias("validity"),
    )


def findings_with_trace(findings: DataFrame, trace: DataFrame) -> DataFrame:
    """(finding_id, call, method): each citation with its call, if the trace has it."""
    cited = findings.select("finding_id", F.explode("evidence").alias("call"))
    return cited.join(trace.select(F.col("id").alias("call"), "method"), "call", "left").select("finding_id", "call", "method")


def paired(drafts: DataFrame, left: str = "drafts", right: str = "stored") -> DataFrame:
    """Drafts beside what was stored for them, by position; the longer list is filled up with nulls."""
    return drafts.select("id", F.posexplode(F.arrays_zip(F.col(left).alias("draft"), F.col(right).alias("stored"))).alias("pos", "p")).select("id", "pos", "p.draft", "p.stored")


def summarized(value, most: int = 128, items: int = 32):
    """An argument as the ledger keeps it: long texts as their length, lists cut, mappings by key."""
    if isinstance(value, str):
        return value if len(value) <= most else f"<{len(value)} chars>"
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes>"
    if isinstance(value, (list, tuple)):
        return [summarized(v, most, items) for v in value[:items]] + ([f"<{len(value) - items} more>"] if len(value) > items else [])
    if isinstance(value, dict):
        return {k: summarized(v, most, items) for k, v in value.items()}
    return value
