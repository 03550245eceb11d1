"""Vector bin packing: every id in one piece, all limits kept, no padding."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, empty, odd_docs, tokenizer, whole  # noqa: F401
from tidewire.llm import queries, vector_packing
from tidewire.llm.vector_packing import Limits, Pool, fill


def check(rows, want, limits=Limits(), prompts=None):
    """``want``: (doc_id, ids with the end id) of each stored row."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == limits.tokens or at & at - 1 == 0 and at < limits.tokens
        assert len(own) <= limits.segments and sum(r.loss_tokens for r in own) <= limits.loss
    expected = {}
    for doc_id, ids in want:
        expected.setdefault(doc_id, []).append(ids)
    assert by_doc.keys() == expected.keys()
    for doc_id, copies in expected.items():
        assert sum(r.length for r in by_doc[doc_id]) == sum(map(len, copies))
        if len(copies) == 1:
            (ids,) = copies
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
                if prompts:
                    assert r.loss_tokens == max(0, at + r.length - max(at, prompts[doc_id]))
                at += r.length
            assert at == len(ids)


def ended(tokenizer, text):
    return np.append(whole(tokenizer, text)[:-1], np.array([0], "<u4")).astype("<u4")


def test_registered_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op12_vector_packing(spark, SF).collect()
    check(rows, [(d.doc_id, ended(tokenizer, d.text)) for d in docs])
    short = [n for n in np.bincount([r.sequence_id for r in rows if r.sequence_id < 1 << 40], [r.length for r in rows if r.sequence_id < 1 << 40]) if n]
    assert sum(n != 1024 for n in short) <= 10  # one tail a task


def test_odd_rows(spark, tokenizer):
    frame = odd_docs(spark).withColumnsRenamed({"size": "key", "n_chars": "_salt", "lang": "ids"})
    rows = vector_packing.pack_examples(frame).collect()
    check(rows, [(r.doc_id, ended(tokenizer, r.text)) for r in frame.collect()])
    assert vector_packing.pack_examples(empty(spark)).count() == 0


def test_reruns_agree_and_equal_rows_spread(spark):
    frame = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("one text that is stored very often").alias("text")).coalesce(2)
    once = sorted(map(tuple, vector_packing.pack_examples(frame, block=100, low=20).collect()))
    assert once == sorted(map(tuple, vector_packing.pack_examples(frame, block=100, low=20).collect()))
    assert len({r[6] >> 40 for r in once}) > 1


@pytest.mark.parametrize("limits", [Limits(256, 4, 256), Limits(256, 64, 60), Limits(128, 3, 40), Limits(100, 5, 7)])
def test_limits_bind_together(spark, tokenizer, limits):
    r = random.Random(5)
    word = lambda n: " ".join(r.choice(["one", "two", "three", "blue", "green"]) for _ in range(n))
    rows = []
    for k in range(400):
        prompt = word(r.randrange(0, 60))
        rows.append((k, prompt + " " + word(r.choice([1, 3, 10, 150])), prompt))
    frame = spark.createDataFrame(rows, "doc_id long, text string, before string")
    prompts = {k: len(tokenizer.encode(p, add_special_tokens=False).ids) for k, _, p in rows}
    check(vector_packing.pack_examples(frame, limits, prompt="before", block=64, low=16).collect(), [(k, ended(tokenizer, t)) for k, t, _ in rows], limits, prompts)


def test_dot_product_takes_what_fits_the_free_limits():
    limits = Limits(100, 8, 100)
    pool = Pool(1)
    for k, (tokens, loss) in enumerate([(60, 60), (40, 0), (39, 39), (40, 40), (60, 0)]):
        pool.put(k, 0, tokens, loss)
    found = [[p[0] for p in own] for own in fill(pool, limits, True)]
    assert found[:2] == [[0, 3], [2, 4, 1]]


def test_a_very_long_text(spark, tokenizer):
    text = "some words, and more; " * 450_000
    frame = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    check(vector_packing.pack_examples(frame).collect(), [(1, ended(tokenizer, text)), (2, ended(tokenizer, "short"))])
