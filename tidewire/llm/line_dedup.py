"""Removing passages that repeat, by overlapping windows of three lines, with DataFrame operations only.

Lines that hold a word are numbered; lines without one are never counted and never removed. Every three consecutive
numbered lines are a window. Of equal windows anywhere in the table the first stays, by doc_id (null last), row hash
and place; the lines of later ones are covered, and covered lines go. If a later window overlaps the first one in
the same document, the first one's three lines stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, let, materialize, row_hash, text_or_empty

WINDOW = 3
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text):
    return F.split(text, "\n", -1)


def window_rows(keyed: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_id, _h, h1, h2, k, at): a row for each window, its 96-bit hash, its number and its lines' places."""

    def windows(lines, at):
        window = lambda k: [lines[at[k + j]] for j in range(size)]
        places = F.sequence(F.lit(0), F.size(at) - size)
        found = F.transform(places, lambda k: F.struct(F.xxhash64(*window(k)).alias("h1"), F.hash(*window(k)).alias("h2"), k.alias("k"), F.slice(at, k + 1, size).alias("at")))
        return F.when(F.size(at) >= size, found)

    full = lambda lines: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: lines[i].rlike(_HAS_WORD))
    own = let(_lines(F.col("_text")), lambda lines: let(full(lines), lambda at: windows(lines, at)))
    return keyed.select("_id", "_h", F.explode(own).alias("w")).select("_id", "_h", "w.*")


def covered_lines(windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """(_id, _h, _gone): for each document that repeats something, the places of the lines to remove.

    The first of equal windows is found by an aggregate, so a window that is everywhere meets in one row, not one
    task. The join that follows brings that row to the windows; its hot keys are split by adaptive execution, as
    nothing after it needs the rows of a hash together.
    """
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_h").alias("h"), F.col("k").alias("k"))
    firsts = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    both = windows.join(firsts, ["h1", "h2"]).where(place > F.col("first"))
    same = (F.col("_id").eqNullSafe(F.col("first.id"))) & (F.col("_h") == F.col("first.h"))
    keep = F.when(same, F.greatest(F.lit(0), F.col("first.k") + size - F.col("k"))).otherwise(0)
    gone = both.select("_id", "_h", F.slice(F.col("at"), keep + 1, F.lit(size)).alias("at")).where(F.size("at") > 0)
    return gone.groupBy("_id", "_h").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("_gone"))


def dedup_lines(docs: DataFrame, text: str = "text", size: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the shortened text in place, and under free names n_lines and n_removed.

    Null texts stay null with no lines; a text that loses nothing stays as it is to the byte; one that loses all
    lines becomes empty. Rows that are equal in all columns are one document stored more than once and keep the same
    lines. The order of columns stays; an empty table stays empty.
    """
    key, h = (col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")), row_hash(docs)
    names = {k: free_name(docs, k) for k in ("n_lines", "n_removed")}
    keyed = docs.select(key.alias("_id"), h.alias("_h"), text_or_empty(text).alias("_text"))
    gone = covered_lines(materialize(window_rows(keyed, size), "windows"), size).withColumnsRenamed({"_id": "_gid", "_h": "_gh"})
    rows = docs.select(key.alias("_id"), h.alias("_h"), F.struct(*[col(c) for c in docs.columns]).alias("_row"))
    joined = rows.join(gone.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_h") == F.col("_gh")), "left")
    own = F.col("_row").getField(text)
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    short = F.when(F.col("_gone").isNull(), own).otherwise(let(_lines(own), lambda lines: F.array_join(F.transform(left(lines), lambda i: lines[i]), "\n")))
    out = [short.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*out, F.when(own.isNull(), 0).otherwise(F.size(_lines(own))).cast("long").alias(names["n_lines"]), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(names["n_removed"])), names


#: The same for unique ids, on the table ``documents``.
ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), shown AS (
    SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
    SELECT doc_id, k, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
    FROM shown WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), placed AS (
    SELECT doc_id, k, first_value(doc_id) OVER w AS first_doc, first_value(k) OVER w AS first_k
    FROM windows WHERE c IS NOT NULL WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, k)
), gone AS (
    SELECT DISTINCT doc_id, p AS k
    FROM (SELECT doc_id, first_doc, first_k, k, unnest([k, k + 1, k + 2]) AS p FROM placed WHERE (doc_id, k) <> (first_doc, first_k))
    WHERE doc_id <> first_doc OR p > first_k + 2
), gone_lines AS (
    SELECT doc_id, i FROM shown JOIN gone USING (doc_id, k)
), left_over AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone_lines USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text,
    CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN left_over l USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone_lines GROUP BY doc_id) g USING (doc_id)
"""
