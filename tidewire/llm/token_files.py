"""Token ids in bit-plane files.

A shard is one file. Ids fill blocks of a fixed size; a block's ids are transposed into planes (plane k holds byte k,
or bit k, of every id), each plane is compressed with zstandard, and all-zero planes take no bytes. Layout, all
little-endian::

    "BPT1"
    planes of block 0, of block 1, ...
    index, zstandard: header, then per block the sizes of its planes (uint32),
        then per document its id (int64), a null mark (uint8) and its number of ids (int64)
    uint64 offset of the index, "BPT1"

Shards are numbered in ascending order of doc_id (null first; equal ids by text hash), so the position of an id in
the whole corpus is the sum of the shards before plus its place in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, parts_for, qualified, text_or_empty
from .files import WholeFile, open_store
from .tokens import default_vocabulary, encoder, with_end

MAGIC = b"BPT1"
BLOCK = 1 << 16
_HEAD = np.dtype([("block", "<u4"), ("bits", "<u4"), ("n_ids", "<u8"), ("n_blocks", "<u8"), ("n_docs", "<u8"), ("width", "<u4"), ("spare", "<u4")])


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """[plane, bytes] of uint32 ids: four byte planes or 32 bit planes."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return planes
    return np.concatenate([np.packbits(np.stack([(p >> k) & 1 for k in range(8)]), axis=1) for p in planes])


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    if bits:
        one = np.unpackbits(planes, axis=1)[:, :n]
        planes = np.stack([sum(one[8 * k + j] << j for j in range(8)).astype(np.uint8) for k in range(4)])
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class ShardWriter:
    def __init__(self, uri: str, block: int = BLOCK, bits: bool = False, level: int = 1):
        self._file = WholeFile(uri)
        self._file.write(MAGIC)
        self._block, self._bits, self._zip = block, bits, zstandard.ZstdCompressor(level=level)
        self._rest, self._n_rest, self._sizes, self._docs, self.n_ids, self.n_docs = [], 0, [], [], 0, 0

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> None:
        self._docs.append((doc_ids.astype("<i8"), null.astype(np.uint8), lengths.astype("<i8")))
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        self._rest.append(ids)
        self._n_rest += len(ids)
        if self._n_rest >= self._block:
            joined = np.concatenate(self._rest)
            whole = len(joined) // self._block * self._block
            for i in range(0, whole, self._block):
                self._write(joined[i : i + self._block])
            self._rest, self._n_rest = [joined[whole:].copy()], len(joined) - whole

    def _write(self, ids: np.ndarray) -> None:
        sizes = []
        for plane in to_planes(ids, self._bits):
            data = self._zip.compress(plane.tobytes()) if plane.any() else b""
            self._file.write(data)
            sizes.append(len(data))
        self._sizes.append(sizes)

    def close(self) -> None:
        if self._n_rest:
            self._write(np.concatenate(self._rest))
        head = np.zeros(1, _HEAD)
        head[0] = (self._block, self._bits, self.n_ids, len(self._sizes), self.n_docs, 32 if self._bits else 4, 0)
        parts = [head.tobytes(), np.array(self._sizes, "<u4").tobytes()] + [b"".join(d[k].tobytes() for d in self._docs) for k in range(3)]
        at = self._file.write(self._zip.compress(b"".join(parts)))
        self._file.write(np.uint64(at).tobytes() + MAGIC)
        self._file.close()


class ShardReader:
    """Reads the index first; blocks come one at a time."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self._in = store.open_input_file(path)
        size = self._in.size()
        tail = self._in.read_at(12, size - 12)
        if tail[8:] != MAGIC or self._in.read_at(4, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        at = int(np.frombuffer(tail[:8], "<u8")[0])
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(self._in.read_at(size - 12 - at, at))
        head = np.frombuffer(raw, _HEAD, 1)[0]
        self.block, self.bits, self.n_ids, self.n_docs = int(head["block"]), bool(head["bits"]), int(head["n_ids"]), int(head["n_docs"])
        width, at = int(head["width"]), _HEAD.itemsize
        self._sizes = np.frombuffer(raw, "<u4", int(head["n_blocks"]) * width, at).reshape(-1, width)
        at += self._sizes.nbytes
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.null = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.lengths = np.frombuffer(raw, "<i8", self.n_docs, at + 9 * self.n_docs)
        self._starts = len(MAGIC) + np.concatenate([[0], np.cumsum(self._sizes.sum(axis=1, dtype=np.int64))])

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        unzip = zstandard.ZstdDecompressor()
        for k in range(first, len(self._sizes)):
            n = min(self.block, self.n_ids - k * self.block)
            data, at = self._in.read_at(int(self._sizes[k].sum()), int(self._starts[k])), 0
            planes = np.zeros((len(self._sizes[k]), (n + 7) // 8 if self.bits else n), np.uint8)
            for j, size in enumerate(self._sizes[k].tolist()):
                if size:
                    planes[j] = np.frombuffer(unzip.decompress(data[at : at + size]), np.uint8)
                at += size
            yield from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Each document's place in the index and its ids, in parts as the blocks cut them."""
        left, parts, doc = self.lengths.tolist(), [], 0
        need = left[0] if left else 0
        for ids in self.blocks():
            at = 0
            while at < len(ids):
                take = min(need, len(ids) - at)
                parts.append(ids[at : at + take])
                at, need = at + take, need - take
                if not need:
                    yield doc, parts
                    parts, doc = [], doc + 1
                    need = left[doc] if doc < len(left) else 0


MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, block: int = BLOCK, bits: bool = False, shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards into ``folder``; returns the manifest, a row for each shard.

    Each document's ids end with id 2. Null texts are empty, null ids come first, equal ids stay in the order of
    their text's hash, an empty table gives no shard, and other columns are ignored. The number of shards, unless given,
    is that of shuffle partitions or more, so that a shard has about 256 MB of input at most. A task that runs again
    writes the same bytes under the same name.
    """
    spark, path = docs.sparkSession, vocabulary or default_vocabulary()
    n, folder = shards or parts_for(docs), qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out = TaskContext.get().partitionId(), None
        uri = f"{folder}/shard-{shard:06d}.bpt"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(uri, block, bits)
            ids, counts = encoder(path).encode(batch.column("text"))
            ids, offsets = with_end(ids, counts)
            key = batch.column("doc_id")
            out.add(ids, key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), np.diff(offsets))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([out.n_docs]), pa.array([out.n_ids])], ["shard", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    manifest = rows.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_digests(manifest: DataFrame) -> DataFrame:
    """From the files: each document's start in the corpus, number of ids and their crc32.

    The manifest has a row for each shard, so the running sum over it is made on the driver.
    """
    spark = manifest.sparkSession
    shards = sorted((r.shard, r.path, r.n_ids) for r in manifest.collect())
    base, rows = 0, []
    for shard, path, n_ids in shards:
        rows.append((shard, path, base))
        base += n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = ShardReader(path)
                crc = np.zeros(shard.n_docs, np.int64)
                for k, parts in shard.documents():
                    x = 0
                    for p in parts:
                        x = zlib.crc32(p, x)
                    crc[k] = x
                start = base + np.cumsum(shard.lengths) - shard.lengths
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.null), pa.array(start), pa.array(shard.lengths), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    if not rows:
        return spark.createDataFrame([], DIGESTS)
    listed = spark.createDataFrame(rows, "shard int, path string, base long")
    return listed.repartition(len(rows), "shard").mapInArrow(read, DIGESTS)


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the shards and returns what reading them back gives."""
    return read_token_digests(write_token_files(docs, folder or new_folder(docs.sparkSession, "tokens"), **options))
