"""Names that clash, very long texts, many matches, and the verdicts of models against a plain evaluation."""

import collections
import glob
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import html, line_dedup, media, mixing, near_dedup, packing, quality, queries, secrets, textstats, token_files, tokens

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the caller.
INNER = ["_id", "_h", "_hash", "_bid", "_bh", "_t", "_base", "_runs", "_both", "_text", "_d", "_object", "_shard", "_wh", "_host", "_labels", "_score", "_score_", "_mix_key", "_mix_more", "_mix_copies", "_mix_rows", "_row", "_size", "_piece", "sequence_id", "offset", "node", "key", "label", "score", "kept", "n_lines", "spans", "digest", "shard", "length", "width", "host", "html_1", "size", "target"]
LONG = "".join(f"word{k % 977} of line {k}\n" for k in range(450_000))  # about 10 MB


def crowded(spark):
    texts = [None, "", "one two three four five six seven", "one two three four five six seven", "l1 a\nl2 b\nl3 c\nl4 d", "l1 a\nl2 b\nl3 c", "x" * 3000]
    rows = [(k if k != 5 else None, t, None if k == 2 else "en", None if k == 3 else f"s{k % 2}", len(t) if t else None) for k, t in enumerate(texts)] + [(4, texts[4], "en", "s0", len(texts[4]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"mine {c}").alias(c) for c in INNER])


def mine(out, frame):
    """The caller's columns are all there, with the caller's values."""
    assert out.columns[: len(frame.columns)] == frame.columns or set(frame.columns) <= set(out.columns)
    for r in out.select(*[F.col(f"`{c}`") for c in INNER if c in out.columns]).distinct().collect():
        assert all(r[c] == f"mine {c}" for c in r.asDict())


def test_clashing_names_stay_the_callers(spark, tmp_path):
    frame = crowded(spark)
    n = frame.count()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = {
        "op1": near_dedup.keep_one(frame),
        "op2": secrets.find_secrets(frame, secrets.train(secrets.default_samples(spark, 50)))[0],
        "op5": mixing.mix(frame)[0],
        "op5 rows": mixing.mixed_rows(frame),
        "op7": line_dedup.dedup_lines(frame)[0],
        "op8": quality.with_quality_score(frame, quality.fit_rules(frame, none))[0],
        "op10": quality.with_verdict(frame, quality.fit_verdict(frame, none))[0],
        "op4": html.extract_main_text(frame.withColumn("url", F.lit("http://a.example/1")).withColumn("html", F.col("text")))[0],
        "op6": media.media_columns(frame, f"file://{tmp_path}/m"),
    }
    for name, out in outs.items():
        rows = out.count()
        assert rows == n or name in ("op1", "op5 rows"), name
        mine(out, frame.drop("text") if name == "op6" else frame)
    assert token_files.token_files(frame, f"file://{tmp_path}/t").count() == n
    assert packing.packed_documents(frame).where("piece = 0").count() == n
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        mine(out, frame)
    assert corpus_pipeline.pack_stage(spark, frame, SF).where("piece = 0").count() == n


def test_a_text_of_ten_megabytes(spark, tmp_path):
    frame = spark.createDataFrame([(1, LONG, "s"), (2, LONG + "tail", "s"), (3, "short text", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    found, _ = secrets.find_secrets(frame, secrets.train(secrets.default_samples(spark, 50)))
    assert found.where("n_assign + n_access + n_hex = 0").count() == 3
    short, n = line_dedup.dedup_lines(frame)
    assert {r.doc_id: r[n["n_removed"]] for r in short.collect()} == {1: 0, 2: 450_000, 3: 0}
    counts = textstats.statistics(pa.array([LONG]))[0]
    assert counts[0] == 4 * 450_000
    stored = {r.doc_id: r for r in media.media_columns(frame, f"file://{tmp_path}/m").collect()}
    assert stored[1].n_bytes == len(LONG)
    rows = packing.packed_documents(frame.where("doc_id = 1")).collect()
    assert sum(r.length for r in rows) == len(tokens.PieceEncoder(tokens.default_vocabulary()).encode(pa.array([LONG]))[0]) + 1
    assert mixing.mix(frame)[0].count() == 3


# ---- op 2


def test_very_many_matches_in_one_text(spark):
    """Each of 100,000 matches is found where it is, and in seconds."""
    r = random.Random(5)
    parts = [f"{r.getrandbits(96):024x}" if k % 2 else f"token={r.getrandbits(40):x}00" for k in range(100_000)]
    text = "; ".join(parts)
    base, at = [], 0
    for k, p in enumerate(parts):
        base.append(f"{'hex' if k % 2 else 'assign'}:{at}:{at + len(p)}")
        at += len(p) + 2
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secrets.find_secrets(frame, secrets.train(secrets.default_samples(spark, 50)))[0].first()
    assert row.spans.split(",") == base and (row.n_assign, row.n_hex) == (50_000, 50_000)


def test_keys_beside_pattern_spans_and_in_paths(spark):
    table = secrets.train(secrets.default_samples(spark))
    key = "q7Zt0XwB4mKc9VhRr2JsYdLf8GpTn5Ua"
    given = {1: f"AKIA{'Z2' * 8}/{key}", 2: f"{'0a1b2c3d' * 3}-{key}", 3: f"account/layer/storage/template/{key}", 4: "account/layer/storage/template/process/window/session"}
    frame = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.secrets if s.kind == "markov"] for r in secrets.find_secrets(frame, table)[0].collect()}
    for k in (1, 2, 3):
        assert len(got[k]) == 1 and got[k][0].match in given[k] and sum(c in got[k][0].match for c in key[4:28]) == 24, k
        assert given[k][got[k][0].start : got[k][0].end] == got[k][0].match
    assert not got[4]


def test_markov_on_words_that_were_not_taught(spark):
    """Names of the table's own made-up words, which no sample has, and of a made-up alphabet of syllables."""
    r = random.Random(9)
    words = sorted({w for t in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").toPandas()["text"] for w in re.findall(r"[a-z]{4,9}", t)})
    taught = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    table = secrets.train(secrets.default_samples(spark, ordinary=taught))
    names = [r.choice("_-/").join(r.choice(words[1::2]) for _ in range(4)) for _ in range(300)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(letters) for _ in range(40)) for _ in range(300)]
    frame = spark.createDataFrame([(k, 0, s) for k, s in enumerate(names) if len(s) >= secrets.LEAST] + [(k, 1, s) for k, s in enumerate(keys)], "k int, random int, text string")
    got = secrets.find_secrets(frame, table)[0].groupBy("random").agg(F.avg((F.col("spans") != "").cast("int")).alias("hit")).collect()
    hit = {g.random: g.hit for g in got}
    assert hit[1] >= 0.98 and hit[0] <= 0.02


# ---- op 4


def plain_pages(seed=3, n=8):
    r = random.Random(seed)
    para = lambda k: " ".join(f"w{r.randrange(400)}" for _ in range(k))
    shared, rows = para(20), []
    for k in range(n):
        menu = "".join(f'<li><a href="/{j}">{para(2)}</a></li>' for j in range(6))
        own = [para(4), *(para(30) for _ in range(r.randint(3, 7))), *([shared] if k % 2 else []), para(25)]
        body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{p}</p>" for p in own[1:-1]) + f"<p>Sign up for our weekly letter today</p><p>{own[-1]}</p>"
        records = "".join(f'<div class="k9"><p>{para(9)}</p></div>' for _ in range(3))
        rows.append((k, f"http://h.example/{k}", f'<div class="a1"><ul>{menu}</ul></div><div class="b2">{body}</div><div class="c3">{records}</div><div class="d4">All rights kept by this place</div>', "\n".join(own)))
    return rows


def test_wrapper_decides_where_names_say_nothing(spark):
    """No class or element names the article: menus of links, groups of records and texts of the template go by the wrapper.

    A text that half of the pages share stays, one that all have goes: only the aligned wrapper tells which texts
    come whenever their container does.
    """
    frame = spark.createDataFrame(plain_pages(), "page_id long, url string, html string, want string")
    out, n = html.extract_main_text(frame)
    for r in out.collect():
        assert r[n["text"]] == r.want
    wrapper = html.infer_wrappers(frame).first()
    shown = html.expression(html._parts(wrapper.stream))
    assert wrapper.pages == 8 and re.search(r"\(=\d+:[0-9a-f]+#div.b>p\)\?", shown) and "(<div.k #div.c>div.k>p </div.k)+" in shown


def test_a_sidebar_in_the_layouts_name(spark):
    page = '<div class="layout with-sidebar"><article><p>{}</p></article><aside>side</aside></div><section class="comments"><article><p>nice</p></article></section>'
    frame = spark.createDataFrame([(k, f"http://s.example/{k}", page.format(f"the text {k} of this page")) for k in range(4)], "page_id long, url string, html string")
    out, n = html.extract_main_text(frame)
    assert all(r[n["text"]] == f"the text {r.page_id} of this page" for r in out.collect())


def test_long_repetitions_fold():
    body = [f"t{k}" for k in range(40)]
    part = lambda *t: [((x,), 0, False) for x in t]
    assert html.expression(html.fold(part("a", *body, *body, *body, "b"))) == f"a ({' '.join(body)})+ b"


# ---- op 8 and 10 against a plain evaluation


@pytest.fixture(scope="module")
def quality_tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def plain_features(texts):
    return textstats.features(textstats.statistics(pa.array(texts, pa.string())))


def test_verdict_equals_a_walk_down_the_trees(spark, quality_tables):
    docs, labels = quality_tables
    model = quality.fit_verdict(docs, labels)

    def walk(x):
        total = model.bias
        for root in model.roots.tolist():
            k = root
            while model.left[k] >= 0:
                k = int(model.left[k]) if x[model.feature[k]] <= model.threshold[k] else int(model.right[k])
            total += model.value[k]
        return 1 / (1 + math.exp(-total))

    judged, n = quality.with_verdict(docs.select("doc_id", "text"), model)
    rows = judged.collect()
    for r, x in zip(rows, plain_features([r.text for r in rows]), strict=True):
        assert r[n["score"]] == pytest.approx(walk(x), abs=1e-9)
        assert r[n["kept"]] == (not r.base_failed and walk(x) >= quality.KEEP_AT)


def test_score_equals_rules_and_weights_by_hand(spark, quality_tables):
    docs, labels = quality_tables
    model = quality.fit_rules(docs, labels)
    assert model.rules
    scored, n = quality.with_quality_score(docs.select("doc_id", "text"), model)
    rows = scored.collect()
    for r, x in zip(rows, plain_features([r.text for r in rows]), strict=True):
        total = model.bias + sum(w for rule, w in zip(model.rules, model.weights, strict=True) if all((x[f] <= t) == low for f, low, t in rule))
        assert r[n["score"]] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert r[n["predicted"]] == int(r[n["score"]] >= quality.PREDICT_AT)


def test_an_id_with_several_texts_is_one_sample(spark):
    docs = spark.createDataFrame([(1, "b a"), (1, "a b c"), (2, "x")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    x, y = quality.labelled_sample(docs, labels)
    assert x.shape[0] == 2 and sorted(y) == [0, 1] and (x[np.argsort(y)] == plain_features(["x", "a b c"])).all()


# ---- the registered queries themselves


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    """A row a document (op4: page, op13: conversation), or pieces of all of them; op11 ranks phrases. A rerun gives the same rows."""
    first, again = (queries.QUERIES[name](spark, SF).collect() for _ in range(2))
    table = {"op4": "pages", "op13": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    n = rows.select("conv_id").distinct().count() if table == "conversations" else rows.count()
    if name.split("_")[0] in ("op3", "op12"):
        assert len({r.doc_id for r in first}) == n
    elif name.split("_")[0] == "op11":
        assert first and [(r.lang, r["rank"]) for r in sorted(first)] == [(x, k) for x in sorted({r.lang for r in first}) for k in range(1, 1 + sum(r.lang == x for r in first))]
    else:
        assert len(first) == n
    assert collections.Counter(map(tuple, first)) == collections.Counter(map(tuple, again))


def test_pipeline_runs_and_leaves_no_steps(spark):
    listed = lambda: set(glob.glob(f"{spark.sparkContext.getConf().get('spark.checkpoint.dir').removeprefix('file:')}/tidewire/*"))
    before = listed()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    left = {os.path.basename(p).rpartition("-")[0] for p in listed() - before}
    assert {n for n, _ in corpus_pipeline.STAGES[:-1]} <= left and not left & {"nodes", "judged", "windows", "sized", "labels"}
