"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

A document's size is its number of words. Every source has a target number of words, and so an expected number of
copies for each of its documents, target / size. Documents of a source stand in a fixed order; the expected copies
are summed along it, one random offset is added, and a document is emitted once for every whole number its stretch
crosses. The order goes from large to small documents, so what is taken comes near the target in words, not only in
copies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, free_name, materialize, materialize_counted, ranked, row_hash, salts_for, text_or_empty

#: Weights by the source's place in code point order (null last), repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most this many times its own size.
MOST = 3.0
SEED = 17


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Targets of the sources: ``sizes`` (source, source_size, one row each) with ``target``.

    The targets share the sum of all sizes by weight. One above ``most`` times its source's size stops there, and
    its excess goes to the others by weight, until none is above. Each round is one aggregate over the sources and
    brings two numbers to the driver, so the number of sources has no limit; ranks come from a range sort.
    """
    spark = sizes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ranks in code point order without one global sort task: bytes of UTF-8 sort as code points do.
    dealt = sizes.withColumn("_null", F.col("source").isNull()).repartitionByRange(n, "_null", "source").sortWithinPartitions("_null", "source").withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    dealt = materialize(dealt, "sources")
    parts = dealt.groupBy("_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row a partition
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("_before") + F.col("_id") - F.col("_first")
    weighed = dealt.join(parts.select("_part", "_first", "_before"), "_part").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).alias("_w"))
    weighed = materialize(weighed.withColumn("_cap", F.col("source_size") * most), "sources")
    level, total = 0.0, weighed.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("_w") * level > F.col("_cap")
        held, open_weight = weighed.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not open_weight:
            break
        new = (total - (held or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * level).alias("target"))


@dataclass(frozen=True)
class Mixed:
    """Names of the columns that :func:`mix` adds."""

    size: str
    source_size: str
    target: str
    copies: str


def mix(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = SEED, keep: list[str] | None = None) -> tuple[DataFrame, Mixed]:
    """Adds to each row its size, its source's size and target, and how many copies the mix takes.

    ``keep`` names the columns to carry (all if None); the text is only carried if it is among them. Null texts have
    size 0, null sources are a source of their own. Rows that are equal in all columns stand side by side and may
    get different numbers of copies, which of them gets which means nothing. Reruns agree: the order is by size, then
    by a hash of the row, and the offset is a hash of the source. An empty table stays empty.
    """
    keep = docs.columns if keep is None else keep
    names = {}
    for k in ("size", "source_size", "target", "copies"):
        names[k] = free_name(docs, k)
    out = Mixed(**names)
    narrow = docs.select(col(source).cast("string").alias("source"), word_count(text_or_empty(text)).alias("_size"), row_hash(docs).alias("_hash"), F.struct(*[col(c) for c in keep]).alias("_row"))
    narrow, seen = materialize_counted(narrow, "sized")
    sizes = narrow.groupBy("source").agg(F.sum("_size").cast("long").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, most), "targets")
    # Strata from large to small: an eighth of a doubling each.
    stratum = -F.floor(F.log2(F.col("_size") + F.lit(1.0)) * 8).cast("int")
    row = ranked(narrow, ["source"], [F.col("_size").desc(), F.col("_hash")], F.col("_hash"), "_rank", salts=salts_for(seen.n), strata=stratum)
    joined = row.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    # The offset is a multiple of 2^-16, so that adding whole expected copies stays exact.
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))), F.lit(65536)) / 65536.0
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(offset + expected * k)
    copies = (upto(F.col("_rank") + 1) - upto(F.col("_rank"))).cast("long")
    done = joined.select(F.col("_row"), F.col("_size").alias(out.size), F.col("source_size").alias(out.source_size), F.col("target").alias(out.target), copies.alias(out.copies))
    return done.select("_row.*", out.size, out.source_size, out.target, out.copies), out


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it, with the columns of ``docs``.

    The mix is computed over narrow rows that carry 128 bits of hashes of theirs, so whole rows move once, for the
    join that repeats them, in one way at every size. Rows that are equal throughout share the copies of all of
    them. Null texts and texts without words have size 0 and are taken like others of their size; null sources are
    a source. An empty table stays empty; columns of any name pass through.
    """
    key, more, copies, rows = (free_name(docs, x) for x in ("_mix_key", "_mix_more", "_mix_copies", "_mix_rows"))
    keyed = docs.withColumn(key, row_hash(docs)).withColumn(more, row_hash(docs, seed=SEED))
    out, names = mix(keyed, keep=[key, more], **options)
    counts, seen = materialize_counted(out.groupBy(col(key), col(more)).agg(F.sum(col(names.copies)).alias(copies), F.count(F.lit(1)).alias(rows)), "copies", again=col(rows) > 1)
    taken = counts.where(col(copies) > 0)
    whole = keyed.join(taken.where(col(rows) == 1).drop(rows).hint("shuffle_hash"), [key, more])
    if seen.again:  # rows that are stored more than once become one row first; only these are grouped
        again = keyed.join(taken.where(col(rows) > 1).drop(rows).hint("shuffle_hash"), [key, more])
        again = again.groupBy(col(key), col(more)).agg(*[F.first(col(c)).alias(c) for c in (*docs.columns, copies)])
        whole = whole.unionByName(again)
    return whole.withColumn(rows, F.explode(F.sequence(F.lit(1).cast("long"), col(copies)))).select(*[col(c) for c in docs.columns])
