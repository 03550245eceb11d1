"""Joins, evidence, upserts and the SQL surface, over ledgers and stored tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, filters, store
from ..schemas import DRAFT
from .registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# Orders play the calls of a ledger: each gave out its customer and its total. Lineitems play citations and claims.
_LEDGER = """ledger AS (SELECT 'tc_' || o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'task' END AS task_id, ['c_' || o_custkey, 'o_' || o_orderkey] AS ref_ids, floor(o_totalprice) AS total FROM (SELECT o_orderkey, min(o_custkey) AS o_custkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderkey))"""
_CITED = """cited AS (SELECT DISTINCT l_suppkey AS draft_id, 'tc_' || CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE l_orderkey END AS call, CASE WHEN l_partkey % 13 = 0 THEN 'c_none' ELSE 'o_' || l_orderkey END AS ref FROM lineitem WHERE l_linenumber = 1)"""
_CLAIMS = """claims AS (SELECT DISTINCT l_suppkey AS draft_id, 'tc_' || l_orderkey AS call, l_orderkey, l_partkey % 17 = 0 AS wrong FROM lineitem WHERE l_linenumber = 2)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"), F.min("o_totalprice").alias("o_totalprice"))
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.concat(F.lit("tc_"), key).alias("id"),
        F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise("task").alias("task_id"),
        F.array(F.concat(F.lit("c_"), F.col("o_custkey").cast("string")), F.concat(F.lit("o_"), key)).alias("ref_ids"),
        F.create_map(F.lit("total"), F.floor("o_totalprice").cast("double")).alias("numbers"),
        F.array(key).alias("tokens"),
    )


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """A draft for each supplier; those without lines of the kind cite nothing."""
    l = _t(spark, d, "lineitem")  # noqa: E741
    key = F.col("l_orderkey").cast("string")
    cites = l.where("l_linenumber = 1").select(F.col("l_suppkey").alias("draft_id"), F.struct(F.concat(F.lit("tc_"), F.when(F.col("l_partkey") % 11 == 0, "-1").otherwise(key)).alias("_id"), F.lit("get").alias("method"), F.when(F.col("l_partkey") % 13 == 0, "c_none").otherwise(F.concat(F.lit("o_"), key)).alias("ref_id")).alias("e"))
    told = l.where("l_linenumber = 2").join(ledger(spark, d).select(F.col("id"), F.col("numbers")["total"].alias("total")), F.concat(F.lit("tc_"), key) == F.col("id"))
    claims = told.select(F.col("l_suppkey").alias("draft_id"), F.struct(F.col("id").alias("_id"), F.lit("total").alias("field"), (F.col("total") + F.when(F.col("l_partkey") % 17 == 0, 1.0).otherwise(0.0)).alias("value")).alias("c"))
    base = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("draft_id"), F.lit("t").alias("title"), F.lit("low").alias("severity"), F.lit("b").alias("basis"), F.lit("s").alias("summary"))
    out = base.join(cites.groupBy("draft_id").agg(F.collect_set("e").alias("evidence")), "draft_id", "left").join(claims.groupBy("draft_id").agg(F.collect_set("c").alias("claims")), "draft_id", "left")
    return out.withColumn("evidence", F.coalesce("evidence", F.array().cast(DRAFT["evidence"].dataType))).withColumn("claims", F.coalesce("claims", F.array().cast(DRAFT["claims"].dataType)))


_ISSUES = f"""WITH {_LEDGER}, {_CITED}, {_CLAIMS},
v1 AS (SELECT s_suppkey AS draft_id, 'V1' AS "check" FROM supplier WHERE s_suppkey NOT IN (SELECT draft_id FROM cited)),
held AS (SELECT c.*, l.id, l.task_id, l.ref_ids FROM cited c JOIN (SELECT DISTINCT s_suppkey FROM supplier) s ON s.s_suppkey = c.draft_id LEFT JOIN ledger l ON l.id = c.call),
v2 AS (SELECT draft_id, 'V2' FROM held WHERE id IS NULL OR task_id <> 'task'),
v3 AS (SELECT draft_id, 'V3' FROM held WHERE task_id = 'task' AND NOT list_contains(ref_ids, ref)),
v4 AS (SELECT draft_id, 'V4' FROM (SELECT DISTINCT draft_id, call FROM claims WHERE wrong AND draft_id IN (SELECT s_suppkey FROM supplier)) c JOIN ledger l ON l.id = c.call),
issues AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3 UNION ALL SELECT * FROM v4)"""


@query(_ISSUES + ' SELECT draft_id, "check", count(*) AS n FROM issues GROUP BY draft_id, "check"')
def evidence_issues(spark, d):
    """J6, J7, V1 to V4."""
    return evidence.issues(drafts(spark, d), ledger(spark, d), "task").groupBy("draft_id", "check").agg(F.count(F.lit(1)).alias("n"))


@query(_ISSUES + """ SELECT s.s_suppkey AS draft_id, CASE WHEN bool_or(i."check" <> 'V4') THEN 'rejected' WHEN count(i."check") > 0 THEN 'downgraded' ELSE 'accepted' END AS status FROM supplier s LEFT JOIN issues i ON i.draft_id = s.s_suppkey GROUP BY s.s_suppkey""")
def evidence_verdicts(spark, d):
    """What becomes of each draft."""
    return evidence.validate(drafts(spark, d), ledger(spark, d), "task")


@query(f"WITH {_CITED} SELECT DISTINCT call, 'get' AS method, ref FROM cited WHERE draft_id IN (SELECT s_suppkey FROM supplier)")
def evidence_index(spark, d):
    """U3."""
    return evidence.evidence_index(drafts(spark, d))


@query("SELECT c_custkey AS id, array_to_string(list_sort(list_distinct([CAST(c_custkey AS VARCHAR), CAST(c_custkey * 97 AS VARCHAR)])), ',') AS bad FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders) AND c_custkey * 97 NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey FROM orders) AND c_custkey * 97 IN (SELECT o_orderkey FROM orders) UNION ALL SELECT c_custkey, CAST(c_custkey * 97 AS VARCHAR) FROM customer WHERE c_custkey IN (SELECT o_orderkey FROM orders) AND c_custkey * 97 NOT IN (SELECT o_orderkey FROM orders)")
def illegal_tokens(spark, d):
    """U4: tokens that no call gave out."""
    texts = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_custkey").cast("string"), (F.col("c_custkey") * 97).cast("string")).alias("tokens"))
    return evidence.illegal_tokens(texts, ledger(spark, d)).select("id", F.array_join("bad", ",").alias("bad"))


@query("SELECT o.o_orderkey AS id, o.o_custkey AS agent_run_id, c.c_nationkey AS task_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 7")
def calls_of_task(spark, d):
    """Orders as calls, customers as runs, nations as tasks."""
    calls = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("agent_run_id"))
    runs = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("task_id"))
    return evidence.calls_of_task(calls, runs, 7).select("id", "agent_run_id", "task_id")


@query("SELECT c_custkey AS id, c_name AS name, CAST(0 AS INT) AS version FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name), 1 FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 5")
def upsert_replaces(spark, d):
    """K5: the newer row of a key stays."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(0).alias("version"))
    return store.upsert(c, c.where("id % 2 = 1").select("id", F.upper("name").alias("name"), F.lit(1).alias("version")), ["id"])


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 <> 0")
def upsert_keeps_first(spark, d):
    """K5: the older row of a key stays."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return store.upsert(c.where("id % 3 = 0"), c.select("id", F.upper("name").alias("name")), ["id"], keep_first=True)


@query("SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def tasks_newest_first(spark, d):
    """L6. Orders with equal date and key are one task."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"))
    return store.tasks_newest_first(o, 20)


@query("SELECT id, severity, rule_id, first_ts FROM (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'High' ELSE 'low' END AS severity, event_type AS rule_id, epoch_us(ts) AS first_ts FROM events) WHERE lower(severity) = 'high' AND rule_id = 'error' ORDER BY first_ts, id LIMIT 50")
def alert_filter(spark, d):
    """severity in any case."""
    own = spark.sql("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'High' ELSE 'low' END AS severity, event_type AS rule_id, unix_micros(CAST(ts AS TIMESTAMP)) AS first_ts, CAST(NULL AS STRING) AS session_id FROM {e}", e=_t(spark, d, "events"))
    return filters.filter_alerts(own, "HIGH", "error").drop("session_id")


@query("SELECT id, severity, rule_id, first_ts FROM (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'High' ELSE 'low' END AS severity, event_type AS rule_id, epoch_us(ts) AS first_ts FROM events) WHERE severity = 'low' ORDER BY first_ts, id LIMIT 50")
def alert_filter_stored(spark, d):
    """exact severity, the first 50."""
    own = spark.sql("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'High' ELSE 'low' END AS severity, event_type AS rule_id, unix_micros(CAST(ts AS TIMESTAMP)) AS first_ts, CAST(NULL AS STRING) AS session_id FROM {e}", e=_t(spark, d, "events"))
    return filters.filter_alerts(own, "low", stored=True).drop("session_id")


@query("SELECT event_type AS rule_id, event_id // 1000 AS block, array_to_string(list(event_id ORDER BY event_id), ',') AS alerts FROM events GROUP BY event_type, event_id // 1000")
def alerts_by_rule(spark, d):
    """Alerts listed by rule, in blocks of ids, so that no list grows with the table."""
    own = _t(spark, d, "events").groupBy(F.col("event_type").alias("rule_id"), F.expr("event_id div 1000").alias("block"))
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("alerts"))


SURFACE = "SELECT n.n_name, r.r_name, rank() OVER (PARTITION BY r.r_name ORDER BY n.n_name) AS place, count(c.c_custkey) AS customers FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name, r.r_name HAVING count(c.c_custkey) > 0"


@query(SURFACE)
def sql_surface(spark, d):
    """A read-only query over views, capped."""
    for t in ("nation", "region", "customer"):
        _t(spark, d, t).createOrReplaceTempView(t)
    return store.read_only_sql(spark, f"-- a comment\n{SURFACE};", 10_000).select("n_name", "r_name", F.col("place").cast("long").alias("place"), "customers")


RECURSIVE = "WITH RECURSIVE s(n, v) AS (SELECT 1, 1 UNION ALL SELECT n + 1, v * 2 FROM s WHERE n < 12) SELECT n, v FROM s"


@query("WITH RECURSIVE s(n, v) AS (SELECT 1, 1 UNION ALL SELECT n + 1, v * 2 FROM s WHERE n < 12) SELECT n, v FROM s")
def sql_surface_recursive(spark, d):
    return store.read_only_sql(spark, RECURSIVE, 100)


@query("SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"' || CASE WHEN event_id % 2 = 0 THEN ',\"even\":true' ELSE '' END || '}' AS value FROM events ORDER BY event_id LIMIT 500")
def json_lines(spark, d):
    """K1, K6: JSON text, nulls left out, a limit in order."""
    own = _t(spark, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, True).alias("even"))
    return store.json_lines(own, "event_id", 500)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def latest_by_key(spark, d):
    """The last row of each key."""
    return store.latest(_t(spark, d, "events"), ["user_id"], "ts").select("user_id", "event_id", "event_type")


@query("SELECT user_id AS run_id, count(*) AS steps, CAST(sum(event_id % 97) AS BIGINT) AS llm_ms, CAST(coalesce(sum(CASE WHEN event_id % 3 = 0 THEN event_id % 11 END), 0) AS BIGINT) AS tool_ms FROM events GROUP BY user_id")
def agent_counters(spark, d):
    """What each run took."""
    from ..operators import trace

    own = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 97).alias("llm_ms"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 11).alias("tool_ms"))
    return trace.counters(own)


@query("""WITH c AS (SELECT user_id AS case_id, list_distinct(list(event_type)) AS actual, count(*) FILTER (WHERE event_type = 'view') AS valid, count(*) FILTER (WHERE event_type IN ('view', 'error')) AS findings FROM events GROUP BY user_id)
SELECT case_id, len(list_intersect(actual, ['view', 'click', 'error'])) / 3.0::DOUBLE AS path_match, CASE WHEN findings = 0 THEN 1.0::DOUBLE ELSE valid / findings::DOUBLE END AS validity FROM c""")
def evaluation_metrics(spark, d):
    """Expected tools that were used, and findings that hold."""
    from ..operators import trace

    own = _t(spark, d, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.collect_set("event_type").alias("actual"), F.count_if(F.col("event_type") == "view").alias("valid"), F.count_if(F.col("event_type").isin("view", "error")).alias("findings"))
    return trace.evaluation(own.withColumn("expected", F.array(*map(F.lit, ["view", "click", "error", "view"]))))


@query("SELECT c.c_custkey AS finding_id, 'o' || k.k AS call, o.o_orderstatus AS method FROM customer c, (SELECT unnest([0, 1, 2]) AS j) j, LATERAL (SELECT c.c_custkey * 31 + j.j * 7 AS k) k LEFT JOIN (SELECT o_orderkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY o_orderkey) o ON o.o_orderkey = k.k")
def findings_with_trace(spark, d):
    """Citations beside their calls, if there are any."""
    from ..operators import trace

    findings = _t(spark, d, "customer").select(F.col("c_custkey").alias("finding_id"), F.array(*[F.concat(F.lit("o"), (F.col("c_custkey") * 31 + 7 * j).cast("string")) for j in range(3)]).alias("evidence"))
    calls = _t(spark, d, "orders").groupBy("o_orderkey").agg(F.min("o_orderstatus").alias("method")).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), "method")
    return trace.findings_with_trace(findings, calls)


@query("SELECT c_custkey AS id, CAST(p AS INT) AS pos, CASE WHEN p < c_custkey % 4 THEN 'd' || p END AS draft, CASE WHEN p < c_custkey % 3 THEN 's' || p END AS stored FROM customer, (SELECT unnest([0, 1, 2]) AS p) WHERE p < greatest(c_custkey % 4, c_custkey % 3)")
def drafts_paired(spark, d):
    """Two lists side by side by position."""
    from ..operators import trace

    named = lambda m, c: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("c_custkey") % m), lambda i: F.concat(F.lit(c), i.cast("string")))
    return trace.paired(_t(spark, d, "customer").select(F.col("c_custkey").alias("id"), named(4, "d").alias("drafts"), named(3, "s").alias("stored")))
