"""Captures of any size read in parts: each task reads a stretch of a file.

Neither format says where records begin, so a stretch is read in three steps. (1) *Index*: a task looks for a record's start in its
stretch that a chain of headers confirms, follows the headers to the first start beyond it, and sums up what they change: the
number of packets, the byte order, the interfaces (:class:`Stretch`). (2) *Compose*: a file's stretches, a row each, are put together in order. A stretch
that began where its predecessor ended is right by induction; one that was misled, by a capture inside a payload for instance, is indexed anew
from where it must begin. Summaries compose: a section header resets the interfaces, others add to them, and packets of
interfaces that the stretch didn't see described count only if those before it were enough. (3) *Read*: stretches are read with the number, byte
order and interfaces they begin with, so packets are those of a scan of the whole file, whatever the size of a stretch.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..schemas import RAW
from .capture import _in_batches, _store, fingerprint, read_captures
from .capture_format import CLASSIC_HEADER_BYTES, HEAD_BYTES, QUIET, SECTION, ClassicHeader, Interface, Notes, ScanState, classic_header, described_interface, detect_format, interface_time, scan_blocks, scan_classic, section_order

PART_BYTES = 64 << 20
#: Headers that must follow one another for a start to be believed, and bytes that are searched at once.
CHAIN, WINDOW = 12, 1 << 16
#: More than any record holds, where the file doesn't say.
MOST_RECORD = 1 << 26


@dataclass
class Stretch:
    """What a stretch of a file changes, as far as it can tell by itself.

    It begins at ``start`` in byte order ``order``, ends before ``end`` in ``order_after``, and ``stopped`` tells that nothing after it is read.
    ``resets`` tells that a section began in it; what follows is of the last one then. ``described`` are its interfaces; numbers count
    from those known at the start (none after a reset). ``sure`` packets count in any case, ``needs[k]`` more if at least k interfaces were
    known at the start. ``times`` has for the number of an interface the raw time of its last packet and how many had to be known for it.
    """

    start: int | None
    end: int | None
    order: str = "<"
    order_after: str = "<"
    stopped: bool = False
    resets: bool = False
    described: list[Interface] = field(default_factory=list)
    sure: int = 0
    needs: dict[int, int] = field(default_factory=dict)
    times: dict[int, tuple[int, int]] = field(default_factory=dict)

    def section(self) -> None:
        self.resets, self.described, self.times = True, [], {}

    def packet(self, number: int, raw: int | None = None) -> None:
        need = max(0, number + 1 - len(self.described))
        if need and self.resets:
            return  # of an interface that its section doesn't describe
        if need:
            self.needs[need] = self.needs.get(need, 0) + 1
        else:
            self.sure += 1
        if raw is not None:
            self.times[number] = raw, need

    def packets(self, known: int) -> int:
        return self.sure + sum(n for k, n in self.needs.items() if k <= known)

    def after(self, before: list[Interface]) -> list[Interface]:
        """The interfaces at its end, if those at its start were ``before``."""
        out = [replace(i) for i in [*([] if self.resets else before), *self.described]]
        for number, (raw, need) in self.times.items():
            if self.resets or need <= len(before):
                out[number].last_ns = interface_time(out[number], 0, raw)
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Stretch:
        d = json.loads(text)
        d["described"] = [Interface(**i) for i in d["described"]]
        d["needs"] = {int(k): n for k, n in d["needs"].items()}
        d["times"] = {int(k): tuple(v) for k, v in d["times"].items()}
        return cls(**d)


class _Held:
    """A stretch of a file in memory, and the rest of the file beside it."""

    def __init__(self, source, start: int, end: int):
        self._source, self.start, self.size = source, start, source.size()
        self.data = source.read_at(max(0, min(end, self.size) - start), start)

    def get(self, at: int, n: int) -> bytes:
        own = self.data[at - self.start : at - self.start + n]
        return own if len(own) == n or at + len(own) >= self.size else self._source.read_at(n, at)


def _follow_blocks(held: _Held, start: int, end: int, order: str) -> Stretch:
    """The stretch from a block's start to the first one at or after ``end``."""
    out = Stretch(start, start, order, order)
    at = start
    while at < end:
        head = held.get(at, 12)
        own = section_order(head) if len(head) == 12 and head[:4] == SECTION_BYTES else out.order_after
        kind, length = struct.unpack(own + "II", head[:8]) if len(head) == 12 else (0, 0)
        if length < 12 or length % 4 or at + length > held.size:
            out.stopped = at < held.size
            break
        if kind == SECTION:
            out.order_after = own
            out.section()
        elif kind == 1:
            out.described.append(described_interface(held.get(at + 8, length - 12), own))
        elif kind == 6:
            number, high, low = struct.unpack(own + "III", held.get(at + 8, 12))
            out.packet(number, high << 32 | low)
        elif kind == 3:
            out.packet(0)
        at += length
    out.end = at
    return out


def _follow_records(held: _Held, start: int, end: int, header: ClassicHeader) -> Stretch:
    out = Stretch(start, start, header.order, header.order)
    at = start
    while at < end:
        head = held.get(at, header.record_bytes)
        length = header.record_bytes + struct.unpack(header.order + "I", head[8:12])[0] if len(head) == header.record_bytes else 0
        if not length or at + length > held.size:
            out.stopped = at < held.size
            break
        out.sure += 1
        at += length
    out.end = at
    return out


SECTION_BYTES = struct.pack("<I", SECTION)
_KINDS = [1, 3, 6, SECTION, *QUIET]


def _block_starts(held: _Held, at: int, upto: int, order: str) -> list[int]:
    """Where in [at, upto) a known block could begin whose length stands at both its ends; starts are multiples of four."""
    n = (min(upto + 8, held.start + len(held.data)) - at) // 4
    words = np.frombuffer(held.data, order + "u4", max(n, 0), at - held.start)
    if len(words) < 3:
        return []
    kind, length = words[:-1], words[1:].astype(np.int64)
    fit = np.flatnonzero(np.isin(kind, np.array(_KINDS, np.uint32)) & (length >= 12) & (length % 4 == 0))
    out = []
    for k in fit.tolist():
        start, long = at + 4 * k, int(length[k])
        if start < upto and start + long <= held.size and held.get(start + long - 4, 4) == struct.pack(order + "I", long):
            out.append(start)
    return out


def _record_starts(held: _Held, at: int, upto: int, header: ClassicHeader) -> list[int]:
    """Where in [at, upto) a record could begin whose header makes sense."""
    own = np.frombuffer(held.data, np.uint8, min(upto + 16, held.start + len(held.data)) - at, at - held.start)
    if len(own) < 17:
        return []
    word = lambda k: sum(own[k + (i if header.order == "<" else 3 - i) : len(own) - 16 + k + (i if header.order == "<" else 3 - i)].astype(np.int64) << 8 * i for i in range(4))
    fraction, captured, original = word(4), word(8), word(12)
    fit = (fraction < header.ticks) & (captured <= original) & (captured <= (header.snap or MOST_RECORD)) & (original <= MOST_RECORD)
    return (at + np.flatnonzero(fit)).tolist()


def _confirmed_blocks(held: _Held, at: int, order: str) -> bool:
    """Whether the blocks from ``at`` on follow one another to the file's end, or many of them do."""
    for _ in range(CHAIN):
        if at == held.size:
            return True
        head = held.get(at, 12)
        if len(head) < 12:
            return False
        if head[:4] == SECTION_BYTES:
            order = section_order(head)
        (length,) = struct.unpack(order + "I", head[4:8])
        if length < 12 or length % 4 or at + length > held.size or held.get(at + length - 4, 4) != struct.pack(order + "I", length):
            return False
        at += length
    return True


def _confirmed_records(held: _Held, at: int, header: ClassicHeader) -> bool:
    """As for blocks; times of records that follow one another are within a day, and not all headers are zeros."""
    last, any_bytes = None, False
    for _ in range(CHAIN):
        if at == held.size:
            return any_bytes
        head = held.get(at, header.record_bytes)
        if len(head) < header.record_bytes:
            return False
        seconds, fraction, captured, original = struct.unpack(header.order + "IIII", head[:16])
        if fraction >= header.ticks or captured > original or (header.snap and captured > header.snap) or (last is not None and abs(seconds - last) > 86_400):
            return False
        any_bytes, last = any_bytes or captured > 0, seconds
        at += header.record_bytes + captured
        if at > held.size:
            return False
    return any_bytes


def index_stretch(source, begin: int, end: int) -> Stretch:
    """The stretch [begin, end) of a file, from the first start that is believed; without one its start is None."""
    head = source.read_at(CLASSIC_HEADER_BYTES, 0)
    if detect_format(head[:HEAD_BYTES]) == "classic":
        header = classic_header(head)
        held = _Held(source, max(begin, CLASSIC_HEADER_BYTES), end)
        if begin == 0:
            return _follow_records(held, CLASSIC_HEADER_BYTES, end, header)
        for at in range(held.start, end, WINDOW):
            for start in _record_starts(held, at, min(at + WINDOW, end), header):
                if _confirmed_records(held, start, header):
                    return _follow_records(held, start, end, header)
        return Stretch(None, None)
    held = _Held(source, -(-begin // 4) * 4, end)
    if begin == 0:
        return _follow_blocks(held, 0, end, "<")
    for at in range(held.start, end, WINDOW):
        found = sorted((start, order) for order in "<>" for start in _block_starts(held, at, min(at + WINDOW, end), order))
        for start, order in found:
            if _confirmed_blocks(held, start, order):
                return _follow_blocks(held, start, end, order)
    return Stretch(None, None)


def index_from(source, start: int, end: int, order: str) -> Stretch:
    """The stretch from a start that is known."""
    head = source.read_at(CLASSIC_HEADER_BYTES, 0)
    held = _Held(source, start, end)
    if detect_format(head[:HEAD_BYTES]) == "classic":
        return _follow_records(held, start, end, classic_header(head))
    return _follow_blocks(held, start, end, order)


@dataclass
class Part:
    """What a task reads, and with what it begins."""

    start: int
    end: int
    index: int
    order: str
    interfaces: list[Interface]


def compose(stretches: list[tuple[int, int, Stretch]], indexed) -> Iterator[Part]:
    """The parts of a file, from (begin, end, stretch) in order; ``indexed(start, end, order)`` indexes one anew that was misled."""
    at, order, index, known = None, "<", 0, []
    for _, end, own in stretches:
        at = own.start if at is None else at
        if at >= end:  # a record of before reaches beyond it
            continue
        if (own.start, own.order) != (at, order):
            own = indexed(at, end, order)
        yield Part(at, own.end, index, order, known)
        index += own.packets(len(known))
        known = own.after(known)
        at, order = own.end, own.order_after
        if own.stopped:
            return


def read_part(source, part: Part) -> Iterator:
    """The packets of a part."""
    head = source.read_at(CLASSIC_HEADER_BYTES, 0)
    own = io.BytesIO(source.read_at(part.end - part.start, part.start))
    if detect_format(head[:HEAD_BYTES]) == "classic":
        return scan_classic(own, Notes(), classic_header(head), part.index)
    return scan_blocks(own, Notes(), ScanState(part.order, [replace(i) for i in part.interfaces], part.index))


def _file(path: str):
    store, own = _store(path)
    return store.open_input_file(own)


_INDEXED = StructType([StructField("path", StringType()), StructField("begin", LongType()), StructField("until", LongType()), StructField("stretch", StringType())])
_PARTS = StructType([StructField("path", StringType()), StructField("part", StringType())])
SCANNED = StructType([StructField("path", StringType()), *RAW.fields])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for path, begin, until in zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "until")], strict=True):
            with _file(path) as source:
                yield path, begin, until, index_stretch(source, begin, until).to_json()


def _composed(table: pa.Table) -> pa.Table:
    (path,) = set(table.column("path").to_pylist())
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("begin", "until", "stretch")], strict=True))
    with _file(path) as source:
        parts = [json.dumps(asdict(p)) for p in compose([(a, b, Stretch.from_json(x)) for a, b, x in rows], lambda *where: index_from(source, *where))]
    return pa.table({"path": pa.array([path] * len(parts), pa.string()), "part": pa.array(parts, pa.string())})


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for path, text in zip(*[batch.column(c).to_pylist() for c in ("path", "part")], strict=True):
            own = json.loads(text)
            own["interfaces"] = [Interface(**i) for i in own["interfaces"]]
            with _file(path) as source:
                for r in read_part(source, Part(**own)):
                    yield path, r.packet_index, r.ts_ns, r.precision, r.interface_id, r.linktype, r.captured_len, r.original_len, r.raw


def parts_of(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, part): the parts of all captures that a path or pattern names, each with what a task must know to read it."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    begins = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(part_bytes).cast("long"))
    ranges = files.select("path", F.explode(begins).alias("begin"), "length").withColumn("until", F.least(F.col("begin") + part_bytes, "length")).drop("length")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = to_arrow_schema(_INDEXED)
    indexed = ranges.repartition(tasks, "path", "begin").mapInArrow(lambda batches: _in_batches(_index(batches), kinds), _INDEXED)
    return indexed.groupBy("path").applyInArrow(_composed, _PARTS)


def scan_captures(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The packets of all captures that a path or pattern names, as :func:`~.capture.read_captures` gives them but for the digest, read in parts.

    An empty file has no packets; a file that is no capture is an error. What is passed over makes no row. Executors must be
    able to open the files. A task holds a part's bytes, and those of its last record.
    """
    kinds = to_arrow_schema(SCANNED)
    parts = parts_of(spark, path, part_bytes)
    return parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "part").mapInArrow(lambda batches: _in_batches(_read(batches), kinds), SCANNED)


def scan_with_digests(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """:func:`scan_captures` with each file's SHA-256 beside its path. Where only Spark can open the files, a file is one task."""
    some = spark.read.format("binaryFile").load(path).select("path").first()
    try:
        _store(some.path if some else "")
    except (pa.ArrowException, OSError):
        return read_captures(spark, path)
    digests = fingerprint(spark, path).select("path", "sha256")
    return scan_captures(spark, path, part_bytes).join(digests, "path").select("path", "sha256", *[f.name for f in RAW.fields])
