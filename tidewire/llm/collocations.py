"""Phrase collocations: which words stand together more often than their parts would by chance.

Texts are cut into pieces, and identical pieces become one with a multiplicity. Distinct pieces are kept as chunks of codes, a
dictionary a chunk (:func:`_chunks`). Phrases are counted length by length. A chunk asks for each phrase it has once,
with its weight; requests are shuffled in blocks by phrase, a bucket adds them up out-of-core in duckdb, numbers the frequent phrases and sends each
chunk that asked the number (:func:`_counted`). A phrase of k + 1 words is asked for only where both phrases of k words in it
are frequent, and is told by their two numbers, so counts are exact at any size (:func:`_advanced`). Prefixes and suffixes of
phrases lie in other buckets than they do; their counts come by joins on those numbers (:func:`_with_parts`).
"""

from __future__ import annotations

import contextlib
import itertools
import os
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder, parts_for, source_bytes, text_or_empty
from .files import release_memory
from .tokens import text_buffers

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that are cut at once, and bytes of distinct pieces in a chunk.
SLICE_BYTES, CHUNK_BYTES = 2 << 20, 24 << 20
#: Buckets aren't made for less text than this, so that blocks of requests stay few and full.
BUCKET_BYTES = 8 << 20
#: What duckdb holds in memory in a task; more goes to the shared folder.
DUCKDB_MEMORY = "400MB"

_OTHER, _BLANK, _BREAK = range(3)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, _OTHER, np.uint8)
    kind[[0x20, 0x09]] = _BLANK
    kind[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return kind, lower


_KIND, _LOWER = _tables()


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as strings; stretches ascend and don't overlap."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)
    own = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own))


def _slices(kind: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE_BYTES that end at a text's end or at a break."""
    at, end = 0, int(offsets[-1])
    while at < end:
        upto = min(end, at + SLICE_BYTES)
        if upto < end:
            doc = int(offsets[np.searchsorted(offsets, upto, "right") - 1])
            if doc > at:
                upto = doc
            else:  # one text is longer: cut it after a break
                breaks = np.flatnonzero(kind[at:upto] == _BREAK)
                if len(breaks):
                    upto = at + int(breaks[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, at, "right")])
                    later = np.flatnonzero(kind[upto:stop] == _BREAK)
                    upto = upto + int(later[0]) + 1 if len(later) else stop
        yield at, upto
        at = upto


def cut_pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(index of the text, piece): lower-cased pieces of texts with a word in them, without white space around."""
    data, offsets = text_buffers(column)
    kinds = _KIND[data]
    for a, b in _slices(kinds, offsets):
        kind = kinds[a:b]
        new = (kind == _BREAK).astype(np.int32)
        inner = offsets[(offsets > a) & (offsets < b)]
        np.add.at(new, inner - a, 1)
        solid = np.flatnonzero(kind == _OTHER)
        if not len(solid):
            continue
        piece = np.cumsum(new, dtype=np.int32)[solid]
        head = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        starts = solid[head]
        ends = solid[np.concatenate([head[1:], [len(solid)]]) - 1] + 1
        yield np.searchsorted(offsets, starts + a, "right") - 1, _strings(_LOWER[data[a:b]], starts, ends)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column("lang")
        for doc, pieces in cut_pieces(batch.column("text")):
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(doc)), pieces.cast(pa.string())], ["lang", "piece"])
    release_memory()


def distinct_pieces(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, piece, n): the distinct pieces of each language and how often each stands in the texts."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(_cut, "lang string, piece string").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


_REQUEST, _STATE = 0, 1
_ASKED = "kind int, chunk long, lang string, bucket int, data binary, n long"
_ASKED_NAMES = ["kind", "chunk", "lang", "bucket", "data", "n"]
_ASKED_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64()]


def _squeezed(ascending: list[np.ndarray], others: list[np.ndarray], raw: bytes = b"") -> bytes:
    """Arrays of one length as byte planes, of ascending ones the steps, and further bytes, compressed."""
    parts = [np.diff(a, prepend=0) for a in ascending] + others
    planes = b"".join(p.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for p in parts)
    head = np.array([len(parts[0]), len(parts), len(raw)], "<i8").tobytes()
    return head + pa.compress(planes + raw, "zstd", asbytes=True)


def _loosed(data: bytes, ascending: int) -> tuple[list[np.ndarray], bytes]:
    n, k, more = np.frombuffer(data, "<i8", 3).tolist()
    raw = pa.decompress(data[24:], 8 * n * k + more, "zstd", asbytes=True)
    arrays = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n * k).reshape(k, 8, n).transpose(0, 2, 1)).view("<i8").reshape(k, n)
    return [np.cumsum(a) if i < ascending else a for i, a in enumerate(arrays)], raw[8 * n * k :]


def _blocks(chunk: int, lang: str, bucket: np.ndarray, weight: np.ndarray, word: pa.Array | None = None, x: np.ndarray | None = None, y: np.ndarray | None = None) -> pa.RecordBatch:
    """A chunk's requests, numbered in their order, as one row for each bucket they go to."""
    order = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[order], return_index=True)
    data = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        code = order[a:b]
        if word is None:
            data.append(_squeezed([code, x[code]], [y[code], weight[code]]))
        else:
            text, bounds = text_buffers(word.take(pa.array(code)))
            data.append(_squeezed([code], [weight[code], np.diff(bounds)], text.tobytes()))
    n = len(own)
    arrays = [np.full(n, _REQUEST), np.full(n, chunk), [lang] * n, own, data, [None] * n]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(arrays, _ASKED_TYPES, strict=True)], _ASKED_NAMES)


def _kept(chunk: int, lang: str, code: np.ndarray, next_: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """A chunk's phrases in order: their codes, whether the phrase at the next word is the next one here, their weights; and how many they are."""
    values = (_STATE, chunk, lang, None, _squeezed([], [code, next_, weight]), int(weight.sum()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ASKED_TYPES, strict=True)], _ASKED_NAMES)


def _unblocked(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Blocks of requests as rows."""
    for batch in batches:
        for chunk, lang, data in zip(*[batch.column(c).to_pylist() for c in ("chunk", "lang", "data")], strict=True):
            if level > 1:
                (code, x, y, weight), _ = _loosed(data, 2)
                own = {"x": pa.array(x), "y": pa.array(y)}
            else:
                (code, weight, lengths), text = _loosed(data, 1)
                bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                own = {"word": pa.StringArray.from_buffers(len(lengths), pa.py_buffer(bounds), pa.py_buffer(text))}
            n = len(code)
            yield pa.RecordBatch.from_pydict({"chunk": np.full(n, chunk), "lang": pa.repeat(pa.scalar(lang), n), "code": pa.array(code), **own, "weight": pa.array(weight)})


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers, by the constants of a well-known finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_buckets(words: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each word, from its bytes alone."""
    data, offsets = text_buffers(words)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    sums = np.add.reduceat(_mixed(place.astype(np.uint64) << np.uint64(8) | data), offsets[:-1])  # no word is empty
    return (_mixed(sums) % np.uint64(buckets)).astype(np.int64)


def _pair_buckets(x: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(_mixed(x.astype(np.uint64)) + y.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _weights(code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The summed weight of each code, in whole numbers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, code, weight)
    return out


def _words(pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of pieces one after the other, and how many each piece has."""
    data, offsets = text_buffers(pieces)
    other = _KIND[data] != _BLANK
    begins = other.copy()
    begins[1:] &= ~other[:-1]
    begins[offsets[:-1]] = True  # a piece begins with a word
    ends = other.copy()
    ends[:-1] &= ~other[1:]
    ends[offsets[1:] - 1] = True
    starts = np.flatnonzero(begins)
    own = data[other]
    lengths = np.flatnonzero(ends) + 1 - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(own)), np.diff(np.searchsorted(starts, offsets))


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct pieces as chunks: for each its codes, and a request for each of its words."""
    first, made, size = TaskContext.get().partitionId() << 32, 0, 0
    held: dict[str, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {}

    def told() -> Iterator[pa.RecordBatch]:
        nonlocal made, size
        for lang, parts in held.items():
            counts, times = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
            coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            code, weight = coded.indices.to_numpy(), np.repeat(times, counts)
            next_ = np.ones(len(code), bool)
            next_[np.cumsum(counts) - 1] = False
            chunk = first + made
            made += 1
            yield _blocks(chunk, lang, _word_buckets(coded.dictionary, buckets), _weights(code, weight, len(coded.dictionary)), coded.dictionary)
            yield _kept(chunk, lang, code, next_, weight)
        held.clear()
        size = 0
        release_memory()

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        own = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            where = np.flatnonzero(own == k)
            pieces = batch.column("piece").take(pa.array(where))
            words, counts = _words(pieces)
            held.setdefault(lang, []).append((words, counts, batch.column("n").to_numpy()[where]))
            size += words.nbytes
        if size >= CHUNK_BYTES:
            yield from told()
    yield from told()


_REPLY, _GRAM = 0, 1
_TOLD = "kind int, chunk long, lang string, data binary, id long, word string, x long, y long, f long"
_TOLD_NAMES = ["kind", "chunk", "lang", "data", "id", "word", "x", "y", "f"]
_TOLD_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _told(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_TOLD_NAMES, _TOLD_TYPES, strict=True)], _TOLD_NAMES)


def _replies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers, sorted by chunk, language and code, as one row for each chunk that asked."""
    now, codes, ids = None, [], []

    def told() -> pa.RecordBatch:
        data = _squeezed([np.concatenate(codes)], [np.concatenate(ids)])
        return _told(kind=[_REPLY], chunk=[now[0]], lang=[now[1]], data=[data])

    for batch in rows:
        chunk, code, id_ = (batch.column(c).to_numpy() for c in ("chunk", "code", "id"))
        heads = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))  # a chunk has one language
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(chunk)], strict=True):
            name = int(chunk[a]), batch.column("lang")[a].as_py()
            if now is not None and name != now:
                yield told()
                codes, ids = [], []
            now = name
            codes.append(code[a:b])
            ids.append(id_[a:b])
    if now is not None:
        yield told()


@contextlib.contextmanager
def _duckdb(folder: str | None):
    """A database of this task, that puts what memory doesn't hold in a folder of its own below ``folder``."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "preserve_insertion_order": False}) as db:
        own = f"{folder}/{uuid.uuid4().hex}" if folder else None
        if own:
            os.makedirs(own)
            db.execute(f"set temp_directory = '{own.replace(chr(39), chr(39) * 2)}'")
        try:
            yield db
        finally:
            if own:
                db.execute("drop table if exists asked")
                shutil.rmtree(own, ignore_errors=True)


def _counted(least: int, level: int, folder: str | None):
    """A bucket's requests added up: its frequent phrases with their numbers and counts, and the number for each chunk that asked."""
    key = "word" if level == 1 else "x, y"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unblocked(batches, level)
        first = next(rows, None)
        if first is None:
            return
        base = TaskContext.get().partitionId() << 40
        with _duckdb(folder) as db:
            asked = pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], rows))
            db.register("given", asked)
            db.execute("create table asked as select * from given")
            db.execute(f"create table frequent as select {base} + row_number() over (order by lang, {key}) as id, * from (select lang, {key}, sum(weight)::bigint as f from asked group by all having sum(weight) >= {least})")
            for batch in db.sql("select * from frequent").to_arrow_reader(100_000):
                own = {c: batch.column(c) for c in batch.schema.names}
                yield _told(kind=np.full(len(batch), _GRAM), **own)
            yield from _replies(db.sql(f"select chunk, lang, code, id from asked join frequent using (lang, {key}) order by chunk, code").to_arrow_reader(100_000))
            db.execute("drop table frequent")
        release_memory()

    return count


def _advanced(asks_more: bool, buckets: int):
    """A chunk's phrases and the numbers of the frequent ones: its phrases that are a word longer, as requests and in order."""

    def advance(states: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if len(states) and len(replies):
            (chunk,), (lang,) = states.column("chunk").to_pylist(), states.column("lang").to_pylist()
            (code, next_, weight), _ = _loosed(states.column("data")[0].as_py(), 0)
            parts = [_loosed(x, 1)[0] for x in replies.column("data").to_pylist()]
            asked, ids = (np.concatenate([p[k] for p in parts]) for k in range(2))
            order = np.argsort(ids)
            asked, ids = asked[order], ids[order]
            local = np.full(int(max(code.max(), asked.max())) + 1, -1, np.int64)
            local[asked] = np.arange(len(asked))
            own = local[code]
            at = np.flatnonzero((next_[:-1] != 0) & (own[:-1] >= 0) & (own[1:] >= 0))
            if len(at):
                pairs, new = np.unique(own[at] * len(asked) + own[at + 1], return_inverse=True)
                times, x, y = weight[at], ids[pairs // len(asked)], ids[pairs % len(asked)]
                out.append(_blocks(chunk, lang, _pair_buckets(x, y, buckets), _weights(new, times, len(pairs)), x=x, y=y))
                if asks_more:
                    out.append(_kept(chunk, lang, new, np.concatenate([np.diff(at) == 1, [False]]), times))
            release_memory()
        return pa.Table.from_batches(out, pa.schema(list(zip(_ASKED_NAMES, _ASKED_TYPES, strict=True))))

    return advance


def _with_parts(grams: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """(id, lang, phrase, last, f, heads, tails): ``heads[k]`` is the count of the first k + 1 words, ``tails[k]`` of the last k + 1."""
    if shorter is None:
        return grams.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
    x = shorter.select(F.col("id").alias("x"), F.col("phrase").alias("x_phrase"), F.col("heads").alias("x_heads"))
    y = shorter.select(F.col("id").alias("y"), "last", F.col("tails").alias("y_tails"))
    own = F.array("f")
    return grams.join(x, "x").join(y, "y").select("id", "lang", F.concat_ws(" ", "x_phrase", "last").alias("phrase"), "last", "f", F.concat("x_heads", own).alias("heads"), F.concat("y_tails", own).alias("tails"), "x", "y")


def quotient(a: Column | str, n: Column | str, left: Column | str, right: Column | str) -> Column:
    """floor(1000 a n / (l r)) as a long; products may have 38 digits."""
    a, n, left, right = (F.col(c).cast("decimal(19,0)") if isinstance(c, str) else c.cast("decimal(19,0)") for c in (a, n, left, right))
    return F.call_function("div", a * n * F.lit(1000).cast("decimal(4,0)"), left * right)


def mine_phrases(docs: DataFrame, lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside_percent: int = 100) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (text, and ``lang``): lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ``longest`` words that stand in pieces at least ``least`` times (a). A cut after the first words gives
    counts l and r of both parts and floor(1000 a n / (l r)), with n all words of the language; the lowest cut counts, of equal ones the
    first. A candidate inside a longer one that has at least ``inside_percent`` percent of its count is dropped. Order is by score and a, greatest
    first, then by phrase in byte order, so ties have a defined rank.

    A null language is ``und``, null texts are empty, repeated rows count as often as they are stored, ids are not looked at and other columns
    go, whatever their names. An empty table, or one without frequent phrases, gives an empty one. All arithmetic is exact: decimals of 38
    digits for products. Hot pieces are summed before they are shuffled; a hot phrase has one request a chunk.
    """
    spark = docs.sparkSession
    buckets = min(parts_for(docs), max(1, -(-source_bytes(docs) // BUCKET_BYTES)))
    folder = new_folder(spark, "duckdb")
    local = folder.removeprefix("file://") if folder.startswith("file:") else None
    asked = materialize(distinct_pieces(docs, lang).mapInArrow(lambda batches: _chunks(batches, buckets), _ASKED), "phrases_1")
    words = asked.where(F.col("kind") == _STATE).groupBy("lang").agg(F.sum("n").alias("n"))
    tables: list[DataFrame] = []
    grams: list[DataFrame] = []
    for level in range(1, longest + 1):
        dealt = asked.where(F.col("kind") == _REQUEST).select("chunk", "lang", "bucket", "data").repartitionById(buckets, F.col("bucket"))
        told = materialize(dealt.mapInArrow(_counted(least, level, local), _TOLD), f"counted_{level}")
        own = told.where(F.col("kind") == _GRAM)
        grams.append(own)
        tables.append(materialize(_with_parts(own, tables[-1] if tables else None), f"parts_{level}"))
        if level < longest:
            states = asked.where(F.col("kind") == _STATE).select("chunk", "lang", "data").groupBy("chunk", "lang")
            replies = told.where(F.col("kind") == _REPLY).select("chunk", "lang", "data").groupBy("chunk", "lang")
            asked = materialize(states.cogroup(replies).applyInArrow(_advanced(level + 1 < longest, buckets), _ASKED), f"phrases_{level + 1}")
    scored = None
    for k in range(2, longest + 1):
        rows = tables[k - 1]
        if k < longest:
            longer = grams[k].select(F.explode(F.array("x", "y")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("in_longer"))
            rows = rows.join(longer, "id", "left").where(F.col("in_longer").isNull() | (F.col("in_longer") * 100 < F.col("f") * inside_percent))
        rows = rows.join(words, "lang")
        cuts = []
        for j in range(1, k):
            left, right = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
            cuts.append(F.struct(quotient("f", "n", left, right).alias("score"), F.lit(j).alias("j"), left.alias("l"), right.alias("r")))
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
        scored = rows if scored is None else scored.unionByName(rows)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), total as (
    select lang, sum(len(w))::bigint as n from worded group by lang
), grams as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
    from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from worded, range(1, 6) as t(k) where len(w) >= k)
    group by all
    having count(*) >= 100
), cuts as (
    select g.lang, g.k, g.phrase, g.f as a, x.f as l, y.f as r, n, j, (1000::hugeint * g.f * n) // (x.f::hugeint * y.f) as score
    from grams as g, range(1, 5) as t(j)
    join total on total.lang = g.lang
    join grams as x on x.lang = g.lang and x.phrase = array_to_string(string_split(g.phrase, ' ')[1:j], ' ')
    join grams as y on y.lang = g.lang and y.phrase = array_to_string(string_split(g.phrase, ' ')[j + 1:], ' ')
    where g.k > j
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), kept as (
    select * from lowest as c
    where not exists (select 1 from lowest as o where o.lang = c.lang and o.k > c.k and contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' ') and 100 * o.a >= 100 * c.a)
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
from kept
qualify rank <= 2000
"""
