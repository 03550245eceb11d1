"""Collocations against a plain count of all phrases."""

import collections
import random
import re

import duckdb
import pyarrow as pa
import pytest

from tests.llm.test_operators import empty, odd_docs
from tidewire.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    found = [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER))]
    return [tuple(w) for w in found if w]


def plain(rows, least, longest=5, top=2000, percent=100):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    covered = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= percent * candidates[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    by_lang = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            by_lang[lang].append((-score, -a, " ".join(p).encode(), (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)))
    return {(lang, rank): (p.decode(), *v) for lang, own in by_lang.items() for rank, (_, _, p, v) in enumerate(sorted(own)[:top], 1)}


def mine(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = df.collect()
    out = {(r.lang, r.rank): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "A", "é", "É", "x y", "日本", "to", "be", "or", "not"]
    gap = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\r\n", " ;"]
    return [(r.choice(["en", "fr", None, "und", ""]), "".join(r.choice(words) + r.choice(gap) for _ in range(r.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("seed,least,longest,top,percent", [(1, 5, 5, 2000, 100), (2, 12, 4, 7, 100), (3, 8, 5, 50, 60), (4, 3, 2, 2000, 100)])
def test_equal_to_a_plain_count(spark, monkeypatch, seed, least, longest, top, percent):
    rows = made(seed, 300)
    got = mine(collocations.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), least=least, longest=longest, top=top, inside_percent=percent))
    want = plain(rows, least, longest, top, percent)
    assert got == want and len(want) > 5


def test_many_chunks_and_slices(spark, monkeypatch):
    rows = made(5, 400)
    whole = {k: list(v) for k, v in ((0, collocations.cut_pieces(pa.array([t for _, t in rows]))),)}
    monkeypatch.setattr(collocations, "SLICE_BYTES", 64)
    parts = list(collocations.cut_pieces(pa.array([t for _, t in rows])))
    assert len(parts) > 50
    flat = lambda found: [(d, p) for doc, own in found for d, p in zip(doc.tolist(), own.to_pylist(), strict=True)]
    assert flat(parts) == flat(whole[0])
    assert [p.split() for _, p in flat(parts) if " " not in p] == [list(w) for _, t in rows for w in pieces(t) if not any(" " in x for x in w)]


def test_chunks_of_a_few_bytes(spark):
    rows = made(6, 300)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    asked = list(collocations.distinct_pieces(frame).toLocalIterator())
    assert sum(r.n for r in asked) == sum(len(pieces(t)) for _, t in rows)
    assert len({(r.lang, r.piece) for r in asked}) == len(asked)


def test_odd_rows(spark):
    frame = odd_docs(spark).withColumnsRenamed({"size": "piece", "n_chars": "n"})
    rows = [(r.lang, r.text) for r in frame.collect()]
    got = mine(collocations.mine_phrases(frame, least=2))
    assert got == plain(rows, 2) and got
    assert collocations.mine_phrases(empty(spark)).count() == 0
    assert collocations.mine_phrases(spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")).count() == 0


def test_a_very_long_text(spark):
    text = "on the one hand " * 650_000
    got = mine(collocations.mine_phrases(spark.createDataFrame([("en", text), ("en", "On the other hand, so.")], "lang string, text string")))
    assert got == plain([("en", text), ("en", "On the other hand, so.")], 100)


def test_products_beyond_64_bits(spark):
    a, n, l, r = 4 * 10**12, 9 * 10**13, 5 * 10**12, 7 * 10**12
    row = spark.createDataFrame([(a, n, l, r)], "f long, n long, l long, r long")
    assert row.select(collocations.quotient("f", "n", "l", "r").alias("s")).first().s == 1000 * a * n // (l * r)


def test_equal_to_sql_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = mine(queries.op11_collocations(spark, sf))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {(x[0], x[1]): tuple(x[2:]) for x in db.execute(collocations.ORACLE_SQL).fetchall()}
    assert got == want and got
