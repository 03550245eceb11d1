"""Evidence: a ledger of calls, and findings that are held against it.

Checks on a draft: V1 it cites something; V2 each cited call was made, for this task; V3 each cited reference came
out of that call; V4 each number it claims is the ledger's. V1 to V3 reject a draft, V4 makes it a hypothesis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-6


def issues(drafts: DataFrame, ledger: DataFrame, task_id: str) -> DataFrame:
    """(draft_id, check, detail): all that is wrong with drafts (draft_id and the columns of a draft)."""
    calls = ledger.select(F.col("id").alias("_call"), F.col("task_id").alias("_task"), "ref_ids", "numbers")
    v1 = drafts.where(F.coalesce(F.size("evidence"), F.lit(0)) < 1).select("draft_id", F.lit("V1").alias("check"), F.lit("no evidence").alias("detail"))
    cited = drafts.select("draft_id", F.explode("evidence").alias("e")).select("draft_id", F.col("e._id").alias("call"), F.col("e.ref_id").alias("ref"))
    held = cited.join(calls, F.col("call") == F.col("_call"), "left")
    v2 = held.where(F.col("_call").isNull() | (F.col("_task") != task_id)).select("draft_id", F.lit("V2"), F.col("call"))
    v3 = held.where(F.col("_call").isNotNull() & (F.col("_task") == task_id) & F.col("ref").isNotNull() & ~F.coalesce(F.array_contains("ref_ids", F.col("ref")), F.lit(False))).select("draft_id", F.lit("V3"), F.col("ref"))
    claims = drafts.select("draft_id", F.explode("claims").alias("c")).select("draft_id", F.col("c._id").alias("call"), F.col("c.field").alias("field"), F.col("c.value").alias("value"))
    told = claims.join(calls, F.col("call") == F.col("_call"), "left").withColumn("known", F.expr("try_element_at(numbers, field)"))
    v4 = told.where(F.col("known").isNull() | (F.abs(F.col("known") - F.col("value")) > TOLERANCE)).select("draft_id", F.lit("V4"), F.col("field"))
    return v1.union(v2).union(v3).union(v4)


def validate(drafts: DataFrame, ledger: DataFrame, task_id: str) -> DataFrame:
    """(draft_id, status): rejected, downgraded or accepted."""
    found = issues(drafts, ledger, task_id).groupBy("draft_id").agg(F.bool_or(F.col("check") != "V4").alias("fatal"))
    return drafts.select("draft_id").join(found, "draft_id", "left").select("draft_id", F.when(F.col("fatal"), "rejected").when(F.col("fatal").isNotNull(), "downgraded").otherwise("accepted").alias("status"))


def evidence_index(drafts: DataFrame) -> DataFrame:
    """Distinct (call, method, ref) of all drafts in the order of their first use."""
    used = drafts.select("draft_id", F.posexplode("evidence").alias("pos", "e")).select("draft_id", "pos", F.col("e._id").alias("call"), F.col("e.method").alias("method"), F.col("e.ref_id").alias("ref"))
    return used.groupBy("call", "method", "ref").agg(F.min(F.struct("draft_id", "pos")).alias("first")).orderBy("first").select("call", "method", "ref")


def calls_of_task(tool_calls: DataFrame, runs: DataFrame, task_id: str) -> DataFrame:
    """The one join of the stored tables: a task's calls through its runs. Runs are filtered first."""
    own = runs.where(F.col("task_id") == task_id).select(F.col("id").alias("agent_run_id"), "task_id")
    return tool_calls.join(own, "agent_run_id")


def packets_by_index(packets: DataFrame, indices: DataFrame) -> DataFrame:
    """Packets of a list of indices (pos, packet_index) in the list's order, repeats included, missing ones left out."""
    return indices.join(packets, indices["packet_index"] == packets["seq"]).drop(indices["packet_index"]).orderBy("pos")


def illegal_tokens(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, bad): tokens of each text (id, tokens) that no call of the ledger gave out."""
    legal = ledger.select(F.explode("tokens").alias("token")).distinct()
    used = texts.select("id", F.explode("tokens").alias("token")).distinct()
    return used.join(legal, "token", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("bad"))
