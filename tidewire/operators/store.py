"""Stored tables: writing, upserts, history, the read-only SQL surface and JSON-lines sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import KEEP_FIRST, STORED_KEYS
from .table_log import TableLog

SQL_MOST = 10_000
#: Changes of the stored tables' form: version, what it does, and the columns that it adds.
MIGRATIONS = (
    (1, "eight tables", {}),
    (2, "alerts name their session", {"alerts": {"session_id": "string"}}),
)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], keep_first: bool = False) -> DataFrame:
    """``new`` over ``old`` by key: the newer row stays, or (``keep_first``) the older one. Of equal keys in ``new`` one stays.

    Keeping the first is an anti-join and an append; replacing is the same the other way round, so no row is sorted.
    """
    new = new.dropDuplicates(keys)
    if old is None:
        return new
    if keep_first:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


class Store:
    """The eight tables under one folder, each a log of deltas (:class:`~.table_log.TableLog`), so a task costs its own rows to store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self, table: str) -> TableLog:
        if table not in STORED_KEYS:
            raise ValueError(f"{table} isn't one of the stored tables")
        return TableLog(self.spark, f"{self.folder}/{table}", STORED_KEYS[table], table in KEEP_FIRST)

    def read(self, table: str) -> DataFrame | None:
        return self.log(table).read()

    def write(self, table: str, rows: DataFrame) -> None:
        self.log(table).append(rows)

    def migration_status(self) -> dict[str, list[tuple[int, str]]]:
        """The migrations that are applied and those that are pending, in order of version."""
        frame = self._migrations().read()
        done = {r.version for r in frame.collect()} if frame is not None else set()  # a row a migration
        told = [(v, text) for v, text, _ in MIGRATIONS]
        return {"applied": [m for m in told if m[0] in done], "pending": [m for m in told if m[0] not in done]}

    def _migrations(self) -> TableLog:
        return TableLog(self.spark, f"{self.folder}/_migrations", ["version"])

    def apply_migrations(self) -> list[tuple[int, str]]:
        """Brings stored tables to the newest form and tells which migrations ran; a second time none does."""
        pending = self.migration_status()["pending"]
        for version, text, columns in MIGRATIONS:
            if (version, text) not in pending:
                continue
            for table, added in columns.items():
                frame = self.read(table)
                missing = {c: kind for c, kind in added.items() if frame is not None and c not in frame.columns}
                if missing:
                    self.log(table).append(frame.limit(0).withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items()}))  # a read has all entries' columns
            self._migrations().append(self.spark.createDataFrame([(version, text)], "version int, description string"))
        return pending

    def views(self) -> list[str]:
        """Registers what is stored as temporary views for SQL."""
        out = []
        for table in STORED_KEYS:
            if (frame := self.read(table)) is not None:
                frame.createOrReplaceTempView(table)
                out.append(table)
        return out


class RefusedQuery(ValueError):
    pass


def read_only_sql(spark: SparkSession, text: str, limit: int = 100) -> DataFrame:
    """A query that only reads, with at most ``limit`` rows; EXPLAIN gets its plan as text.

    It must begin with SELECT, WITH or EXPLAIN, be one statement, and parse to a query: Spark's own parser says
    whether it is a command.
    """
    if not 1 <= limit <= SQL_MOST:
        raise RefusedQuery(f"a limit is 1 to {SQL_MOST}")
    bare = re.sub(r"\A(?:\s|--[^\n]*\n|/\*.*?\*/)+", "", text, flags=re.S).rstrip().rstrip(";")
    word = (re.match(r"[A-Za-z]+", bare) or [""])[0].lower()
    if word not in ("select", "with", "explain"):
        raise RefusedQuery("only SELECT, WITH and EXPLAIN are let through")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(bare)
    name = plan.getClass().getSimpleName()
    if word != "explain" and ("Command" in name or "Insert" in name or "Create" in name or "Replace" in name or "Drop" in name):
        raise RefusedQuery(f"{name} isn't a query")
    frame = spark.sql(bare)
    return frame if word == "explain" else frame.limit(limit)


def tasks_newest_first(tasks: DataFrame, limit: int = 20) -> DataFrame:
    return tasks.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def stored_sessions(frame: DataFrame, sort: str = "bytes", limit: int = 20, compat: bool = False) -> DataFrame:
    """The page of stored sessions. ``compat`` first takes the page by bytes and then sorts within it, as the interface does."""
    order = {"bytes": "bytes", "packets": "packets", "duration": "last_ts" if compat else "duration_s"}[sort]
    if compat:
        return frame.orderBy(F.col("bytes").desc(), "id").limit(limit).orderBy(F.col(order).desc(), "id")
    return frame.orderBy(F.col(order).desc(), "id").limit(limit)


def json_lines(events: DataFrame, order: str | None = None, limit: int = 0) -> DataFrame:
    """Rows as JSON text in ``value``; null fields are left out. A limit needs an order, 0 is no limit."""
    columns = [c for c in events.columns]
    if limit:
        events = (events.orderBy(order) if order else events).limit(limit)
    return events.select(F.to_json(F.struct(*columns)).alias("value"))


def write_json_lines(events: DataFrame, path: str, order: str | None = None, limit: int = 0) -> None:
    json_lines(events, order, limit).write.text(path)


def emitted(packets: DataFrame, mode: str = "all") -> DataFrame:
    """What of the packets reaches a sink: all, errors_only or none. Rules see all of them in any mode."""
    if mode not in ("all", "errors_only", "none"):
        raise ValueError(f"mode {mode!r}")
    return packets if mode == "all" else packets.where(F.size("errors") > 0 if mode == "errors_only" else F.lit(False))


def latest(frame: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return frame.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
