"""Media columns: payloads in tar shards under their digest, rows that point into the shards, header reads for metadata.

A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are the samples of a grey 8-bit PNG image 64
pixels wide, so any payload is stored without loss and compressed. Images are members of tar shards, named by the
SHA-256 of the payload; a shard stores a digest once. A row carries digest, shard, offset and length of the image
inside the shard. If more than one shard holds a digest, all rows point to the first of them. Metadata (width, height,
depth) come from a read of the first 33 bytes of a member; features from its samples.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, materialize, new_folder, parts_for, qualified, text_or_empty
from .files import WholeFile, open_store

UNIT = 64
SHARD_BYTES = 1 << 30
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = len(_SIGNATURE) + 25


def payload_of(data: bytes) -> bytes:
    n = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return data.ljust(n, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit image, 64 samples a row, each row after its filter byte 0. Equal payloads give equal bytes."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a whole PNG header")
    return struct.unpack(">IIBB", data[16:26])


def png_samples(data: bytes) -> bytes:
    """The samples of an image written by :func:`to_png`."""
    width, height, _, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written")
    return rows[:, 1:].tobytes()


class TarShard:
    def __init__(self, uri: str):
        self._file, self._held = WholeFile(uri), {}

    @property
    def size(self) -> int:
        return self._file.at

    def put(self, digest: bytes, payload: bytes) -> tuple[int, int]:
        """Offset and length of the digest's image; stores it if it is new here."""
        if digest not in self._held:
            image = to_png(payload)
            member = tarfile.TarInfo(f"{digest.hex()}.png")
            member.size = len(image)
            self._file.write(member.tobuf(tarfile.USTAR_FORMAT))
            self._held[digest] = (self._file.write(image), len(image))
            self._file.write(b"\0" * (-len(image) % 512))
        return self._held[digest]

    def close(self) -> None:
        self._file.write(b"\0" * 1024)
        self._file.close()


POINTERS = "digest binary, n_bytes long, payload_bytes long, shard string, offset long, length long"


def store_payloads(df: DataFrame, folder: str, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Writes the texts' images and returns ``df`` without its text, with digest, sizes and place under free names, materialized.

    A task writes its own shards, under names that no other attempt has, so rows of a task that ran twice point into
    the files of the attempt that counts. Null texts are empty; equal texts are one object; no rows give no shard.
    """
    kept = [c for c in df.columns if c != text]
    names, wide = {}, df.select(*[col(c) for c in kept])
    for name, kind in (x.strip().split(" ") for x in POINTERS.split(",")):
        names[name] = free_name(wide, name)
        wide = wide.withColumn(names[name], F.lit(None).cast(kind))
    schema, folder = wide.schema, qualified(df.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, uri, n, held = None, "", 0, []
        for batch in batches:
            rows = []
            for value in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist():
                if shard and shard.size > SHARD_BYTES:
                    shard.close()
                    shard = None
                if shard is None:
                    uri = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{n:04d}-{uuid.uuid4().hex[:12]}.tar"
                    shard, n = TarShard(uri), n + 1
                payload = payload_of(value)
                digest = hashlib.sha256(payload).digest()
                rows.append((digest, len(value), len(payload), uri, *shard.put(digest, payload)))
            added = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], f) for f in (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + added, names=[f.name for f in schema.fields])
        if shard:
            shard.close()

    pointers = df.select(*[col(c) for c in kept], text_or_empty(text).alias(free_name(df, "_text"))).mapInArrow(write, schema)
    return materialize(pointers, "pointers"), names


def objects_of(pointers: DataFrame, names: dict[str, str]) -> DataFrame:
    """(digest, shard, offset, length): one place for each digest, the first of those that hold it."""
    place = F.struct(col(names["shard"]).alias("shard"), col(names["offset"]).alias("offset"), col(names["length"]).alias("length"))
    return pointers.groupBy(col(names["digest"]).alias("digest")).agg(F.min(place).alias("p")).select("digest", "p.*")


METADATA = "digest binary, width int, height int, depth int, colour int"
FEATURES = "digest binary, shard string, offset long, length long, width int, height int, depth int, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _by_shard(objects: DataFrame) -> DataFrame:
    """Objects in runs of one shard, in the order of their places. Shards go by a number, as the ranges' samples reach the driver."""
    number = free_name(objects, "_shard")
    dealt = objects.withColumn(number, F.xxhash64("shard"))
    return dealt.repartitionByRange(parts_for(objects), number, "offset").sortWithinPartitions(number, "shard", "offset").drop(number)


def read_metadata(objects: DataFrame) -> DataFrame:
    """(digest, width, height, depth, colour) of ``objects`` (digest, shard, offset, length): reads 33 bytes of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            heads = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if shard != name:
                    store, path = open_store(shard)
                    name, file = shard, store.open_input_file(path)
                heads.append(png_header(file.read_at(HEADER_BYTES, offset)))
            parts = np.array(heads, np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *[pa.array(parts[:, k]) for k in range(4)]], ["digest", "width", "height", "depth", "colour"])

    return _by_shard(objects).mapInArrow(read, METADATA)


def read_objects(objects: DataFrame) -> DataFrame:
    """``objects`` with metadata from a header read and digests and a feature from the stored bytes, read back.

    The feature has the image's form and the mean, the number of distinct values and the entropy of its samples.
    """
    fields = [f.split(" ") for f in FEATURES.split(", ")]
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if shard != name:
                    store, path = open_store(shard)
                    name, file = shard, store.open_input_file(path)
                width, height, depth, _ = png_header(file.read_at(HEADER_BYTES, offset))
                image = file.read_at(length, offset)
                samples = png_samples(image)
                counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
                share = counts[counts > 0] / len(samples)
                entropy = abs(float(-(share * np.log2(share)).sum()))
                mean = float((counts * np.arange(256)).sum()) / len(samples)
                feature = f"png {width}x{height}x{depth} mean={mean:.4f} distinct={int((counts > 0).sum())} entropy={entropy:.4f}"
                rows.append((digest, shard, offset, length, width, height, depth, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    return _by_shard(objects).mapInArrow(read, FEATURES)


def media_columns(df: DataFrame, folder: str | None = None, text: str = "text") -> DataFrame:
    """Stores the texts and returns the other columns with the pointers, the metadata and the features of the stored form."""
    pointers, n = store_payloads(df, folder or new_folder(df.sparkSession, "media"), text)
    own = pointers.drop(n["shard"], n["offset"], n["length"])
    about = materialize(read_objects(objects_of(pointers, n)), "objects")
    for c in about.columns:  # clashing names of the caller's columns stay theirs
        about = about.withColumnRenamed(c, free_name(own, c if c != "digest" else "_object"))
    return own.join(about, col(n["digest"]) == col(free_name(own, "_object"))).drop(free_name(own, "_object"))
