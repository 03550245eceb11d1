"""A corpus made ready for training: five stages, each over all that the one before it kept.

Quality rules drop documents, line dedup shortens texts, near-dedup keeps one document of each class, mixing drops and
repeats documents, and packing places the token pieces of the rest in sequences. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import line_dedup, mixing, near_dedup, packing, quality
from tidewire.llm.common import col, new_folder, passing_steps


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees' verdict go; the trees learn from the labelled ones among ``docs``.

    Null and empty texts have no words and fail. A verdict depends on the text alone, so repeated rows share theirs;
    null ids only teach nothing. Without labels every document that passes the base rules stays. An empty table stays
    empty, and columns of any name pass through.
    """
    model = quality.fit_verdict(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept, _ = quality.with_verdict(docs, model, only_kept=True)
    return kept


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; n_chars follows the text where the table has it. No document goes.

    Null texts stay null; a text may become empty. Of equal windows the first stays by id (null last), row hash and
    place; rows that are equal throughout keep the same lines. An empty table stays empty, and columns of any name pass through.
    """
    short, names = line_dedup.dedup_lines(docs)
    own = [F.when(col(names["n_removed"]) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(col(c)).alias(c) if c == "n_chars" else col(c) for c in docs.columns]
    return short.select(*own)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the least id.

    A null id is the last to stay, ties fall to the least row hash, and rows that are equal throughout become one. All
    null and empty texts are one class. An empty table stays empty, and columns of any name pass through.
    """
    return near_dedup.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Null sources are a source, the last in order. Null texts have size 0 and are taken as often as their source's
    others. Rows that are equal throughout share their copies. An empty table stays empty, and columns of any name pass through.
    """
    return mixing.mixed_rows(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece with its sequence and its place there.

    Null and empty texts are a piece with the end id alone; null ids stay null; every repeated row is packed. Further
    columns go, as a piece is no document. An empty table gives an empty one.
    """
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: The trees and the tokenizer can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name)
        with passing_steps(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
