"""Near-duplicate documents by DartMinHash signatures, banded joins and an exact check.

Each shingle (five words) is an element with a weight. Hashed darts fall evenly on the plane of (element's weight,
rank); a dart that falls inside an element's region [0, weight) x [0, limit) counts, and each of the k coordinates
keeps the dart with the least rank. A document looks at ranks up to a limit inverse to its total weight, so it throws
about k ln k darts however many shingles it has; two documents agree in a coordinate with the probability of their
weighted Jaccard similarity. With unit weights that is the Jaccard similarity of the sets of shingles.

Equal texts become one node first. Nodes that agree in all coordinates of a band meet in a bucket. A node's score is the
sum of its buckets' sizes: the text that many others were made from meets more of them than they meet each other, so
it scores highest. Each member is compared with its bucket's first and last node by score, so the number of comparisons
grows with the members, not with their pairs, and as the same node leads in all its buckets, a group of copies gives
few distinct pairs. A pair is judged by the share of equal coordinates if that is far from the threshold, and else by
its exact similarity. Members of a bucket that still lie in different classes meet again by the rarest of their shingles,
which similar texts must share, in rounds of ever more centres until no two of different classes are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, materialize, materialize_counted, row_hash, text_or_empty
from .components import components
from .files import release_memory
from .textstats import SLICE_BYTES, Slice, mix, slices, windows

SHINGLE = 5
SIMILAR = 0.8
_SEED = np.uint64(0xA0761D6478BD642F)
#: Chances of no dart, at most one, ... in a cell of unit area, on 32 bits.
_POISSON = np.floor(np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(13)]) * 2**32).astype(np.uint64)
_FRACTION = 48
#: Cells looked at together; about 130 bytes of work arrays each.
CELLS = 400_000


@dataclass(frozen=True)
class Bands:
    """``rows`` coordinates make a band. At similarity 0.8, a pair shares none of 40 bands of 6 once in 190,000."""

    rows: int = 6
    bands: int = 40

    @property
    def k(self) -> int:
        return self.rows * self.bands


def shingle_sets(s: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) for the distinct shingles of each document, in order. A text of fewer words is one shingle."""
    starts, ends, doc = s.words()
    word = s.hashes(starts, ends)
    first, gram = windows(word, doc, size)
    owner = doc[first]
    n_words = np.bincount(doc, minlength=s.n)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        begin = np.searchsorted(doc, short)
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = n_words[short] > k
            own[has] = mix(own[has] * np.uint64(31) + word[begin[has] + k] + np.uint64(k + 1))
        owner, gram = np.concatenate([owner, short]), np.concatenate([gram, own])
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], gram[at], np.diff(np.append(at, len(gram)))


def dart_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """[document, coordinate] ranks (fixed point) of n weighted sets; a document without elements has the largest number.

    The plane is cut into cells of unit area, (element, whole part of the weight, whole part of the rank); a cell's
    darts come from a hash of these three, so equal elements have equal darts in all documents.
    """
    out = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n)
    target = k * (np.log(k) + 3.0)
    open_ = total > 0
    done = np.zeros(n, np.int64)  # ranks below this have been looked at
    with np.errstate(divide="ignore"):
        limit = np.where(open_, np.ceil(target / np.maximum(total, 1e-300)), 0).astype(np.int64)
    while open_.any():
        mine = np.flatnonzero(open_[owner])
        layers = np.ceil(weight[mine]).astype(np.int64)
        ranks = limit[owner[mine]] - done[owner[mine]]
        cells = layers * ranks
        upto = np.cumsum(cells)
        cut = [0, *np.searchsorted(upto, np.arange(CELLS, upto[-1], CELLS), "left").tolist(), len(mine)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            part, m = mine[i:j], cells[i:j]
            el = np.repeat(part, m)
            place = np.arange(len(el)) - np.repeat(np.cumsum(m) - m, m)
            depth = np.repeat(ranks[i:j], m)
            layer, rank = (place // depth).astype(np.uint64), place % depth + done[owner[el]]
            seed = mix(element[el] + _SEED * (rank.astype(np.uint64) + np.uint64(1)) + layer * np.uint64(0xE7037ED1A0B428DB))
            darts = np.searchsorted(_POISSON, seed >> np.uint64(32), "right")
            many = np.repeat(np.arange(len(el)), darts)
            number = np.arange(len(many)) - np.repeat(np.cumsum(darts) - darts, darts)
            h = mix(seed[many] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x8EBC6AF09C88C6E3))
            hit = el[many]
            if (layers != weight[mine]).any():  # inside the weight?
                h2 = mix(h + np.uint64(1))
                inside = layer[many] + (h2 >> np.uint64(11)).astype(float) * 2.0**-53 < weight[hit]
                many, h, hit = many[inside], h[inside], hit[inside]
            value = (rank[many].astype(np.uint64) << np.uint64(_FRACTION)) | (h >> np.uint64(64 - _FRACTION))
            coordinate = (h & np.uint64(0xFFFF)).astype(np.int64) * k >> 16
            np.minimum.at(out, owner[hit] * k + coordinate, value)
        done = np.where(open_, limit, done)
        open_ = open_ & (out.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        limit = np.where(open_, done + np.maximum(1, done), limit)  # some coordinate is still empty: twice as far
    return out.reshape(n, k)


def band_keys(ranks: np.ndarray, bands: Bands) -> np.ndarray:
    """[document, band] one hash for each band's coordinates."""
    cut = ranks.reshape(len(ranks), bands.bands, bands.rows)
    out = np.broadcast_to(np.arange(1, bands.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), cut.shape[:2]).copy()
    for k in range(bands.rows):
        out = mix(out + cut[:, :, k])
    return out.view(np.int64)


def node_of(text: Column) -> Column:
    """Equal texts are one node: the 128 bits of their MD5."""
    return F.unhex(F.md5(text))


def nodes_of(docs: DataFrame, text: str, bands: Bands, weighted: bool) -> DataFrame:
    """(node, n, keys, marks): a row for each distinct text with its number of shingles, band keys, and a byte of each coordinate."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for first, last, data, offsets in slices(column, SLICE_BYTES):
                s = Slice.of(data, offsets)
                owner, gram, count = shingle_sets(s)
                ranks = dart_minhash(owner, gram, count.astype(float) if weighted else np.ones(len(gram)), s.n, bands.k)
                marks = (mix(ranks) & np.uint64(0xFF)).astype(np.uint8)
                n = np.bincount(owner, minlength=s.n).astype(np.int32)
                keys, has = band_keys(ranks, bands), n > 0
                mark_bytes = pa.array([m.tobytes() if k else b"" for m, k in zip(marks, has.tolist(), strict=True)], pa.binary())
                key_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * bands.bands)]).astype(np.int32)), pa.array(keys[has].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, last - first), pa.array(n), key_lists, mark_bytes], ["node", "n", "keys", "marks"])
            release_memory()

    signed = docs.select(node_of(text_or_empty(text)).alias("node"), text_or_empty(text).alias("text")).mapInArrow(sign, "node binary, n int, keys array<long>, marks binary")
    return signed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))


def _pairs(rows: DataFrame, centres: list[str]) -> DataFrame:
    """Distinct pairs of a node and its bucket's centres, the lesser first."""
    ends = rows.select("node", F.explode(F.array(*centres)).alias("c")).where("node <> c")
    return ends.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


#: Standard deviations of the estimate between which a pair is checked exactly.
DOUBT = 4.0
#: Fewer nodes than this are broadcast to the scan that fetches their texts; at 16 bytes each that is 1.6 MB.
BROADCAST_NODES = 100_000


def gram_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, grams): the distinct shingles of the texts whose node is in ``wanted``, 8 bytes each, in ascending order."""
    wanted, seen = materialize_counted(wanted, "wanted")
    texts = docs.select(node_of(text_or_empty(text)).alias("node"), text_or_empty(text).alias("text"))
    texts = texts.join(F.broadcast(wanted) if seen.n <= BROADCAST_NODES else wanted, "node", "left_semi")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text")):
                s = Slice.of(data, offsets)
                owner, gram, _ = shingle_sets(s)
                ends = np.searchsorted(owner, np.arange(s.n + 1))
                sets = pa.array([gram[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, last - first), sets], ["node", "grams"])
            release_memory()

    return materialize(texts.mapInArrow(grams, "node binary, grams binary").groupBy("node").agg(F.first("grams").alias("grams")), "sets")


def _judged(pairs: DataFrame, nodes: DataFrame, bands: Bands, similar: float) -> DataFrame:
    """(a, b, doubt): the pairs that may be similar enough, by equal coordinates; ``doubt`` where these don't decide."""
    doubt = DOUBT * (similar * (1 - similar) / bands.k) ** 0.5

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, bands.k) for c in ("ma", "mb"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            share = (a == b).mean(axis=1)
            share = (share - 1 / 256) / (1 - 1 / 256)  # what bytes have in common by chance
            most = np.minimum(na, nb) / np.maximum(na, nb)  # no pair is more similar than its sizes
            sure = np.where((share < similar - doubt) | (most < similar), 0, np.where(share > similar + doubt, 1, 2))
            keep = pa.array(sure > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sure == 2)], ["a", "b", "doubt"]).filter(keep)

    mark = nodes.select("node", "n", "marks")
    with_a = pairs.join(mark.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("marks").alias("ma")), "a")
    with_b = with_a.join(mark.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("marks").alias("mb")), "b")
    return materialize(with_b.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(estimate, "a binary, b binary, doubt boolean"), "judged")


def _compared(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is high enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(compare, "a binary, b binary")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more links between the classes of ``labels``."""
    for c in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    links = materialize(links, "between")
    found = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    known = labels.union(links.select("a", "of_a")).union(links.select("b", "of_b")).distinct()
    return materialize(known.join(found.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label")), "labels")


#: Counters of how often shingles occur, by which they are ordered: 2 MB for each worker, whatever the input.
COUNTERS = 1 << 18
#: A group has up to GROWTH centres in the first round, and GROWTH times as many in each further one.
GROWTH = 64


def rare_shingles(sets: DataFrame, similar: float) -> DataFrame:
    """(key, node, n, rest): the rarest shingles of each node, ``rest`` of whose n come no earlier, itself included.

    The order is the same for all nodes: by a counter that the shingle shares with others by its hash, then by the
    shingle. If a and b are similar enough, they have at least similar / (1 + similar) * (n_a + n_b) shingles in
    common, so for the first one in the order that they share, both rests are at least that, and it is among the
    first n - similar * n + 1 of either. A shingle that nothing else shares a counter with is left out.
    """
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for g in batch.column("grams").to_pylist():
                np.add.at(table, (np.frombuffer(g, np.uint64) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(table[used])], ["place", "n"])

    counted = sets.select("grams").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[counted.column("place").to_numpy()] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            keys, places, sizes, rests = [], [], [], []
            for k, g in enumerate(batch.column("grams").to_pylist()):
                x = np.frombuffer(g, np.uint64)
                n = len(x)
                if not n:
                    continue
                times = often[(x & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((x, times))[: n - int(np.ceil(similar * n - 1e-9)) + 1]
                at = np.flatnonzero(times[order] > 1)
                keys.append(x[order[at]].view(np.int64))
                places.append(np.full(len(at), k))
                sizes.append(np.full(len(at), n, np.int32))
                rests.append((n - at).astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("node").take(pa.array(np.concatenate(places))), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(rests))], ["key", "node", "n", "rest"])

    return materialize(sets.mapInArrow(rarest, "key long, node binary, n int, rest int"), "rare")


def _rest_of_large_buckets(left: DataFrame, labels: DataFrame, docs: DataFrame, text: str, similar: float) -> DataFrame:
    """``labels`` after all further links among the nodes of ``left`` (key, node), buckets with members that haven't met.

    A bucket doesn't say which of its members are similar, so what its members share is looked at more closely: nodes
    meet again if they share a shingle that is rare enough in both (:func:`rare_shingles`). Texts of one template
    that differ in more than the threshold allows no longer meet, whatever their number.
    """

    def unlike(rows: DataFrame) -> DataFrame:
        own = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = own.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("members")).where("x <> y").select("key", "members")
        return own.join(mixed, "key")

    sets = gram_sets(docs, text, unlike(left).select("node").distinct())
    left = rare_shingles(sets, similar)
    slots = GROWTH
    while True:
        sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        named, seen = materialize_counted(unlike(left).join(sizes, "label", "left").select("key", "node", "n", "rest", "label", "members", F.coalesce("size", F.lit(1)).alias("size")), "named")
        if not seen.n:
            return labels
        # Members of the smallest classes have most to meet; among them, the one that shares most.
        few = F.col("members") <= slots
        best = named.groupBy("key", F.when(few, F.col("node")).alias("own"), F.pmod(F.xxhash64("node"), F.lit(slots)).alias("slot")).agg(F.max(F.struct((-F.col("size")).alias("size"), "rest", "node", "n", "label")).alias("c"))
        centres = best.select(F.col("key").alias("c_key"), F.col("c.node").alias("c"), F.col("c.n").alias("c_n"), F.col("c.rest").alias("c_rest"), F.col("c.label").alias("c_label"))
        able = (F.col("label") != F.col("c_label")) & (F.least("rest", "c_rest") >= similar / (1 + similar) * (F.col("n") + F.col("c_n")) - 1e-9)
        pairs = named.join(centres, (F.col("key") == F.col("c_key")) & able).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
        links, seen = materialize_counted(_compared(pairs, sets, similar), "links")
        if seen.n:
            labels = _merged(labels, links)
        left = named.where(~few).join(centres.select(F.col("c_key").alias("key"), F.col("c").alias("node")), ["key", "node"], "left_anti").select("key", "node", "n", "rest")
        slots *= GROWTH


def node_classes(docs: DataFrame, text: str = "text", bands: Bands | None = None, similar: float = SIMILAR, weighted: bool = False) -> DataFrame:
    """(node, label): the class of each distinct text of ``docs``; a node without links is its own label."""
    bands = bands or Bands()
    nodes = materialize(nodes_of(docs, text, bands, weighted), "nodes")
    rows = nodes.select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, "key").select("key", "node", "n"), "shared")
    met = shared.join(shared.groupBy("node").agg(F.sum("n").alias("score")), "node").select("key", "n", F.struct("score", "node").alias("m"))
    ends = met.groupBy("key").agg(F.max("m").alias("hi"), F.min("m").alias("lo"))
    placed = materialize(met.join(ends, "key").select("key", "n", F.col("m.node").alias("node"), F.col("hi.node").alias("hi"), F.col("lo.node").alias("lo")), "placed")
    judged = _judged(_pairs(placed, ["hi", "lo"]), nodes, bands, similar)
    unsure = judged.where("doubt").select("a", "b")
    sets = gram_sets(docs, text, unsure.select(F.col("a").alias("node")).union(unsure.select("b")).distinct())
    labels = components(judged.where("NOT doubt").select("a", "b").unionByName(_compared(unsure, sets, similar)))
    # Up to three members of a bucket have all met now.
    left = placed.where("n > 3 AND node <> hi AND node <> lo").select("key", "node")
    labels = _rest_of_large_buckets(left, labels, docs, text, similar)
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_classes(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """(doc_id, _h, class_id, class_size) for each row: its id, its row hash, and the least id of its class.

    Equal texts always share a class; null counts as empty, and texts without words have no other links. The class id
    is null if no row of the class has an id. Rows that are equal throughout are members like any other.
    """
    key = col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    members = docs.select(key.alias("doc_id"), row_hash(docs).alias("_h"), node_of(text_or_empty(text)).alias("node"))
    labels = node_classes(docs, text, **options)
    named = materialize(members.join(labels, "node").select("doc_id", "_h", "label"), "members")
    classes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("_best"))
    return named.join(classes, "label").select("doc_id", "_h", "class_id", "class_size", "_best", "label")


def keep_one(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the least id (null last), then the least row hash; equal rows collapse.

    Whole rows move once, by their id and hash, at every size of the table. Columns of any name pass through.
    """
    best_id, best_hash, id_, h = (free_name(docs, x) for x in ("_bid", "_bh", "_id", "_hash"))
    near = near_classes(docs, text, **options)
    best = materialize(near.select(F.col("_best.doc_id").alias(best_id), F.col("_best._h").alias(best_hash)).distinct(), "best")
    key = col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    keyed = docs.withColumn(id_, key).withColumn(h, row_hash(docs))
    same = lambda x, y: col(id_).eqNullSafe(col(x)) & (col(h) == col(y))
    # Rows that are stored more than once.
    again = materialize(near.groupBy("doc_id", "_h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(best_id), F.col("_h").alias(best_hash)), "repeated")
    if not again.limit(1).count():
        return keyed.join(best.hint("shuffle_hash"), same(best_id, best_hash), "left_semi").select(*[col(c) for c in docs.columns])
    both = [col(best_id), col(best_hash)]
    gone = [F.col("_gid").eqNullSafe(both[0]), F.col("_gh") == both[1]]
    once = best.join(again.select(both[0].alias("_gid"), both[1].alias("_gh")), gone, "left_anti")
    twice = best.join(again.select(both[0].alias("_gid"), both[1].alias("_gh")), gone, "left_semi")
    whole = keyed.join(once.hint("shuffle_hash"), same(best_id, best_hash), "left_semi").select(*[col(c) for c in docs.columns])
    folded = keyed.join(twice, same(best_id, best_hash), "left_semi").groupBy(col(id_), col(h)).agg(*[F.first(col(c)).alias(c) for c in docs.columns])
    return whole.unionByName(folded.select(*[col(c) for c in docs.columns]))
