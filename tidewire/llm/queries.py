"""The registered queries of the operators, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, conversations, html, line_dedup, media, mixing, near_dedup, packing, quality, secrets, token_files, vector_packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.col("text"), "[^A-Za-z]+")).alias("word")).where(F.length("word") > 2)
    table = secrets.train(secrets.default_samples(spark, ordinary=words))
    found, n = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), table)
    return found.select("doc_id", *[F.col(n[c]).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = html.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", F.col(n["text"]).alias("text"), F.col(n["n_chars"]).alias("n_chars"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, n = mixing.mix(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", n.size, n.source_size, n.target, (F.col(n.copies) * F.col(n.size)).alias("taken"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, n = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return short.select("doc_id", "text", F.col(n["n_lines"]).alias("n_lines"), F.col(n["n_removed"]).alias("n_removed"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_rules(docs, _table(spark, sf_dir, "labels"))
    scored, n = quality.with_quality_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col(n["score"]).alias("score"), F.col(n["predicted"]).alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_verdict(docs, _table(spark, sf_dir, "labels"))
    judged, n = quality.with_verdict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", *[F.col(n[c]).alias(c) for c in (*quality.VERDICT, "base_failed", "kept", "score")])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_examples(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_mixing": op5_mixing,
    "op6_media_columns": op6_media_columns,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_vector_packing": op12_vector_packing,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {"op7_line_dedup": line_dedup.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL}
