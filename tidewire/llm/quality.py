"""Quality by document statistics: rules with boosted trees (which documents stay), and a sparse rule ensemble (a score)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import col, free_name, text_or_empty
from .files import release_memory
from .textstats import COUNTS, FEATURES, features, statistics, with_statistics

#: Models are fitted to at most this many labelled rows, those whose ids have the smallest hashes.
FIT_ROWS = 6000
#: Features that may only lower the verdict as they rise: symbols, repeated lines and words, shouting, tables, marks.
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "upper_word_share", "bar_share", "bang_share"]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model learns from; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, keep_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of labelled rows, the same in every run.

    Rows with a null id or a label other than 0 and 1 teach nothing. The sample's ids are at most ``rows``, so
    they are broadcast to the one scan that finds their texts. An id that several rows have stands for the least of
    their texts.
    """
    ids = labels.select(col("doc_id").cast("long").alias("_id"), col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    if keep_out:
        ids = ids.where(~held_out(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(col("doc_id").cast("long").alias("_id"), text_or_empty().alias("_text")).join(F.broadcast(ids), "_id").groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_text").alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(statistics(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["_id", "_y", "_x"])
        release_memory()

    got = texts.mapInArrow(measure, "_id long, _y int, _x array<double>").toArrow()
    x = np.array(got["_x"].to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T[::-1], got["_id"].to_numpy()))  # the same rows in the same order, however they came
    return x[order], got["_y"].to_numpy()[order].astype(float)


def fit_verdict(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> boosting.Trees:
    x, y = labelled_sample(docs, labels, rows=rows)
    return boosting.fit(x, y, np.array([-1 if f in FALLING else 0 for f in FEATURES]))


#: Below this score the trees reject a document.
KEEP_AT = 0.5
VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fewer than 10 words, or more than a fifth of the words in repeated five-word windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def with_verdict(df: DataFrame, model: boosting.Trees, keep_at: float = KEEP_AT, only_kept: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """Adds the contract's counts, base_failed, score and kept under free names, or (``only_kept``) drops what is rejected and adds nothing.

    Null and empty texts have no words and fail. A row depends on its own text alone, so ties, repeated rows and
    empty tables need no care; all other columns pass through untouched.
    """
    kinds = dict.fromkeys(VERDICT, "long") | {"base_failed": "boolean", "score": "double", "kept": "boolean"}
    names, wide = {}, df
    if not only_kept:
        for name, kind in kinds.items():
            names[name] = free_name(wide, name)
            wide = wide.withColumn(names[name], F.lit(None).cast(kind))
    schema, plain = wide.schema, free_name(wide, "_text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = statistics(batch.column(batch.num_columns - 1))
            failed = base_failed(counts)
            score = model.score(features(counts))
            kept = ~failed & (score >= keep_at)
            columns = batch.columns[:-1]
            if not only_kept:
                columns = columns + [pa.array(counts[:, k]) for k in range(5)] + [pa.array(failed), pa.array(score), pa.array(kept)]
            out = pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
            yield out.filter(pa.array(kept)) if only_kept else out
            del columns, out
            release_memory()

    return df.select(*[col(c) for c in df.columns], text_or_empty().alias(plain)).mapInArrow(add, schema), names


@dataclass(frozen=True)
class RuleEnsemble:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    bias: float

    def column(self, names: dict[str, str]) -> Column:
        """The score as a Spark expression over statistics columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            parts = [col(names[FEATURES[f]]) <= t if low else col(names[FEATURES[f]]) > t for f, low, t in rule]
            total = total + F.when(reduce(Column.__and__, parts), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def text(self) -> list[str]:
        """The rules in words, the heaviest first."""
        rows = sorted(zip(self.weights, self.rules, strict=True), key=lambda r: -abs(r[0]))
        return [f"{w:+.3f}  " + " and ".join(f"{FEATURES[f]} {'<=' if low else '>'} {t:.6g}" for f, low, t in rule) for w, rule in rows]


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, penalty: float = 0.001) -> RuleEnsemble:
    """Boosts shallow trees on the sample, takes every path as a rule, and lets the lasso keep few of them.

    Learns only from rows that are not held out; labels, language, source and id are no inputs.
    """
    x, y = labelled_sample(docs, labels, rows=rows, keep_out=True)
    rules = boosting.paths(boosting.fit(x, y, trees=30, depth=3, rate=0.3))
    fired = boosting.fires(rules, x)
    first: dict[bytes, int] = {}
    for k in range(len(rules)):  # rules that hold for the same rows count once
        first.setdefault(fired[:, k].tobytes(), k)
    own = sorted(first.values())
    rules = [rules[k] for k in own]
    weights, bias = boosting.lasso_logistic(fired[:, own], y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-9).tolist()
    return RuleEnsemble([rules[k] for k in kept], [float(weights[k]) for k in kept], bias)


PREDICT_AT = 0.3


def with_quality_score(df: DataFrame, model: RuleEnsemble, predict_at: float = PREDICT_AT) -> tuple[DataFrame, dict[str, str]]:
    """Adds score (0 to 1) and predicted (0 or 1) under free names. Null and empty texts have statistics of zero and a score too."""
    wide, names = with_statistics(df)
    score, predicted, raw = free_name(df, "score"), free_name(df, "predicted"), free_name(wide, "_score")
    out = wide.withColumn(raw, model.column(names)).drop(*[names[c] for c in (*COUNTS, *FEATURES)]).withColumnRenamed(raw, score)
    return out.withColumn(predicted, F.when(col(score) >= predict_at, 1).otherwise(0)), {"score": score, "predicted": predicted}
