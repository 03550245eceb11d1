"""Reading capture files: the classic format in four byte orders and two precisions, and the block format.

A reader is a generator over bytes. What doesn't stop the scan (an unknown interface, a block kind that is passed
over, a tail that was cut off) comes out as a note; what does is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

HEAD_BYTES = 16
#: Magic number as read, little-endian -> byte order, ticks a second.
CLASSIC = {
    0xA1B2C3D4: ("<", 1_000_000),
    0xD4C3B2A1: (">", 1_000_000),
    0xA1B23C4D: ("<", 1_000_000_000),
    0x4D3CB2A1: (">", 1_000_000_000),
    0xA1B2CD34: ("<", 1_000_000),
    0x34CDB2A1: (">", 1_000_000),
}
SECTION = 0x0A0D0D0A
BYTE_ORDER = 0x1A2B3C4D
#: Block kinds that are passed over without a note.
QUIET = {4: "name_resolution", 5: "statistics", 9: "journal", 10: "secrets", 0x80000001: "process"}


class UnsupportedCapture(ValueError):
    pass


def detect_format(head: bytes) -> str:
    """``classic`` or ``blocks`` from the first 16 bytes."""
    if len(head) < HEAD_BYTES:
        raise UnsupportedCapture("a capture has at least 16 bytes")
    (magic,) = struct.unpack("<I", head[:4])
    if magic in CLASSIC:
        return "classic"
    if magic == SECTION:
        return "blocks"
    raise UnsupportedCapture(f"unknown magic number {magic:#010x}")


def precision_of(ticks: int) -> str:
    return "ns" if ticks >= 1_000_000_000 else "us" if ticks >= 1_000_000 else "ms" if ticks >= 1000 else "s"


def ticks_to_ns(seconds: int, fraction: int, ticks: int) -> int:
    return seconds * 1_000_000_000 + fraction * 1_000_000_000 // ticks


@dataclass
class Interface:
    linktype: int
    ticks: int = 1_000_000
    offset: int = 0
    last_ns: int = 0


@dataclass
class Record:
    packet_index: int
    ts_ns: int
    precision: str
    interface_id: int
    linktype: int
    captured_len: int
    original_len: int
    raw: bytes


@dataclass
class Notes:
    """What the scan passed over."""

    counts: dict[str, int] = field(default_factory=dict)
    nonfatal: list[str] = field(default_factory=list)

    def add(self, kind: str, text: str | None = None) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + 1
        if text:
            self.nonfatal.append(text)


def _exactly(source: BinaryIO, n: int) -> bytes | None:
    data = source.read(n)
    return data if len(data) == n else None


def read_capture(source: BinaryIO, notes: Notes | None = None) -> Iterator[Record]:
    """All records of a capture in file order. A tail that was cut off ends the scan with a note."""
    notes = notes if notes is not None else Notes()
    head = source.read(HEAD_BYTES)
    kind = detect_format(head)
    yield from _classic(source, head, notes) if kind == "classic" else _blocks(source, head, notes)


@dataclass(frozen=True)
class ClassicHeader:
    order: str
    ticks: int
    linktype: int
    record_bytes: int
    snap: int


CLASSIC_HEADER_BYTES = 24


def classic_header(head: bytes) -> ClassicHeader:
    """What the first 24 bytes of a classic file tell."""
    if len(head) < CLASSIC_HEADER_BYTES:
        raise UnsupportedCapture("the file header was cut off")
    (magic,) = struct.unpack("<I", head[:4])
    order, ticks = CLASSIC[magic]
    snap, link = struct.unpack(order + "II", head[16:24])
    return ClassicHeader(order, ticks, link & 0xFFFF, 24 if magic in (0xA1B2CD34, 0x34CDB2A1) else 16, snap)


def _classic(source: BinaryIO, head: bytes, notes: Notes) -> Iterator[Record]:
    yield from scan_classic(source, notes, classic_header(head + source.read(CLASSIC_HEADER_BYTES - HEAD_BYTES)))


def scan_classic(source: BinaryIO, notes: Notes, header: ClassicHeader, index: int = 0) -> Iterator[Record]:
    """Records that follow, from a record's start on."""
    order, ticks, linktype, extra = header.order, header.ticks, header.linktype, header.record_bytes - 16
    while True:
        record = source.read(16 + extra)
        if not record:
            return
        if len(record) < 16 + extra:
            notes.add("truncated", "a record header was cut off")
            return
        seconds, fraction, captured, original = struct.unpack(order + "IIII", record[:16])
        data = _exactly(source, captured)
        if data is None:
            notes.add("truncated", "a record was cut off")
            return
        yield Record(index, ticks_to_ns(seconds, fraction, ticks), precision_of(ticks), 0, linktype, captured, original, data)
        index += 1


def _options(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(data):
        code, n = struct.unpack(order + "HH", data[at : at + 4])
        if code == 0:
            return
        yield code, data[at + 4 : at + 4 + n]
        at += 4 + (n + 3) // 4 * 4


@dataclass
class ScanState:
    """What a scan of blocks knows at a block's start: the section's byte order and interfaces, and the number of packets before."""

    order: str = "<"
    interfaces: list[Interface] = field(default_factory=list)
    index: int = 0


def section_order(start: bytes) -> str:
    """Byte order by the first 12 bytes of a section header."""
    return "<" if struct.unpack("<I", start[8:12])[0] == BYTE_ORDER else ">"


def described_interface(body: bytes, order: str) -> Interface:
    own = Interface(struct.unpack(order + "H", body[:2])[0])
    for code, value in _options(body[8:], order):
        if code == 9 and value:
            own.ticks = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == 14 and len(value) == 8:
            own.offset = struct.unpack(order + "q", value)[0]
    return own


def interface_time(own: Interface, high: int, low: int) -> int:
    ticks = high << 32 | low
    return ticks_to_ns(ticks // own.ticks + own.offset, ticks % own.ticks, own.ticks)


def _blocks(source: BinaryIO, head: bytes, notes: Notes) -> Iterator[Record]:
    yield from scan_blocks(source, notes, ScanState(), head)


def scan_blocks(source: BinaryIO, notes: Notes, state: ScanState, head: bytes = b"") -> Iterator[Record]:
    """Records of the blocks that follow, from a block's start on; ``head`` was read before. ``state`` goes along."""
    pending = head
    while True:
        start = pending + (source.read(12 - len(pending)) if len(pending) < 12 else b"")
        pending = b""
        if not start:
            return
        if len(start) < 12:
            notes.add("truncated", "a block header was cut off")
            return
        if struct.unpack("<I", start[:4])[0] == SECTION:
            state.order = section_order(start)
            state.interfaces = []  # a section has interfaces of its own
        order, interfaces = state.order, state.interfaces
        kind, length = struct.unpack(order + "II", start[:8])
        if length < 12 or length % 4:
            notes.add("bad_block", f"a block of {length} bytes")
            return
        have = start[8:]
        want = length - 8
        body = have + source.read(want - len(have)) if want > len(have) else have[:want]
        if want < len(have):
            pending = have[want:]
        if len(body) < want:
            notes.add("truncated", "a block was cut off")
            return
        body = body[:-4]
        if kind == SECTION:
            continue
        if kind == 1:
            interfaces.append(described_interface(body, order))
        elif kind == 6:
            number, high, low, captured, original = struct.unpack(order + "IIIII", body[:20])
            if number >= len(interfaces):
                notes.add("unknown_interface", f"packet of interface {number}, which isn't described")
                continue
            own = interfaces[number]
            own.last_ns = interface_time(own, high, low)
            yield Record(state.index, own.last_ns, precision_of(own.ticks), number, own.linktype, captured, original, body[20 : 20 + captured])
            state.index += 1
        elif kind == 3:
            if not interfaces:
                notes.add("unknown_interface", "a simple packet before any interface")
                continue
            (original,) = struct.unpack(order + "I", body[:4])
            data = body[4 : 4 + original]
            yield Record(state.index, interfaces[0].last_ns, precision_of(interfaces[0].ticks), 0, interfaces[0].linktype, len(data), original, data)
            state.index += 1
        elif kind in QUIET:
            notes.add(QUIET[kind])
        else:
            notes.add("unknown_block", f"block kind {kind:#x}")
