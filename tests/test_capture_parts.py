"""Captures read in parts against a scan of the whole file."""

import io
import random
import struct

import pyarrow as pa
import pytest

from tidewire.sources import synth
from tidewire.sources.capture_format import Notes, read_capture
from tidewire.sources.capture_parts import Stretch, compose, index_from, index_stretch, read_part, scan_captures


class Memory:
    def __init__(self, data):
        self._data = data

    def size(self):
        return len(self._data)

    def read_at(self, n, at):
        return self._data[at : at + n]


def as_rows(records):
    return [(r.packet_index, r.ts_ns, r.precision, r.interface_id, r.linktype, r.captured_len, r.original_len, r.raw) for r in records]


def in_parts(data, size):
    source = Memory(data)
    anew = []

    def indexed(*where):
        anew.append(where)
        return index_from(source, *where)

    stretches = [(a, min(a + size, len(data)), Stretch.from_json(index_stretch(source, a, min(a + size, len(data))).to_json())) for a in range(0, len(data), size)]
    parts = list(compose(stretches, indexed))
    return [r for p in parts for r in as_rows(read_part(source, p))], parts, anew


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    n = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + n + body + n


def section(order="<"):
    return block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)


def interface(resolution=6, linktype=1, offset=None, order="<"):
    options = struct.pack(order + "HHB3x", 9, 1, resolution) + (struct.pack(order + "HHq", 14, 8, offset) if offset else b"") + b"\0\0\0\0"
    return block(1, struct.pack(order + "HHI", linktype, 0, 0) + options, order)


def packet(number, ticks, data, order="<"):
    return block(6, struct.pack(order + "IIIII", number, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data) + 3) + data, order)


def simple(data, order="<"):
    return block(3, struct.pack(order + "I", len(data)) + data, order)


def made(seed, n=300, hostile=False):
    """Sections in both byte orders, interfaces described between packets, packets of interfaces that are not, simple and other blocks."""
    r = random.Random(seed)
    out, order, known = [section()], "<", 0
    for k in range(n):
        what = r.random()
        if what < 0.02:
            order, known = r.choice("<>"), 0
            out.append(section(order))
        elif what < 0.08:
            out.append(interface(r.choice([6, 9, 3, 0x80 | 20]), r.choice([1, 113]), r.choice([None, 1000, -5]), order))
            known += 1
        elif what < 0.2:
            out.append(simple(r.randbytes(r.randrange(30)), order))
        elif what < 0.25:
            out.append(block(r.choice([4, 5, 0x0BAD, 10]), r.randbytes(12), order))
        else:
            data = r.randbytes(r.randrange(200))
            if hostile and r.random() < 0.5:
                data = section(r.choice("<>")) + interface() + b"".join(packet(0, k, b"inner") for _ in range(r.randrange(30)))
            out.append(packet(r.randrange(known + 2), (1 << 34) * k + 7, data, order))
    return b"".join(out)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("hostile", [False, True])
def test_block_files(seed, hostile):
    data = made(seed, hostile=hostile)
    want = as_rows(read_capture(io.BytesIO(data)))
    for size in (64, 1000, 4096, len(data) // 4 + 1, len(data) + 1):
        got, parts, anew = in_parts(data, size)
        assert got == want
        assert all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False))
    assert len(want) > 40


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("nano", [False, True])
def test_classic_files(big, nano):
    r = random.Random(4)
    inner = synth.classic_file([(10**18 + k, b"inner" * 3) for k in range(40)], nano, big)
    kinds = [b"", b"\0" * 100, inner, r.randbytes(70), b"\0" * 5000]
    data = synth.classic_file([(1_700_000_000_000_000_000 + k * 10**6, r.choice(kinds)) for k in range(300)], nano, big)
    want = as_rows(read_capture(io.BytesIO(data)))
    for size in (50, 1000, 4096, len(data) // 4 + 1):
        assert in_parts(data, size)[0] == want


def test_ordinary_files_are_indexed_once():
    frames = list(synth.traffic("mixed", 4000))
    for data in (synth.block_file(frames), synth.classic_file(frames)):
        got, parts, anew = in_parts(data, len(data) // 8)
        assert len(parts) > 7 and not anew and got == as_rows(read_capture(io.BytesIO(data)))


def test_cut_and_broken_files():
    r = random.Random(9)
    for whole in (made(3, 60), synth.classic_file(list(synth.traffic("mixed", 60)))):
        for cut in [*range(28, len(whole), 97), len(whole) - 1]:
            data = whole[:cut]
            assert in_parts(data, 300)[0] == as_rows(read_capture(io.BytesIO(data)))
        for _ in range(40):
            data = bytearray(whole)
            at = r.randrange(28, len(data) - 8)
            data[at : at + 4] = r.randbytes(4)
            want = []
            try:
                for x in read_capture(io.BytesIO(bytes(data)), Notes()):
                    want += as_rows([x])
            except Exception:
                continue  # a scan of the whole file fails too
            assert in_parts(bytes(data), 300)[0] == want


def test_a_record_longer_than_a_part():
    data = section() + interface() + packet(0, 1, b"x" * 5000) + packet(0, 2, b"y") + interface(9) + packet(1, 3, b"z" * 3000) + simple(b"end")
    want = as_rows(read_capture(io.BytesIO(data)))
    assert in_parts(data, 256)[0] == want and len(want) == 4


def test_scan_in_parts(spark, tmp_path):
    frames = list(synth.traffic("mixed", 800))
    files = {"a.pcapng": made(11, hostile=True), "b.pcap": synth.classic_file(frames), "c.pcapng": synth.block_file(frames, interfaces=3), "d.pcap": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in scan_captures(spark, str(tmp_path / "*.pcap*"), 20_000).orderBy("path", "packet_index").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(tuple(r)[1:])
    assert got == {name: as_rows(read_capture(io.BytesIO(data))) for name, data in files.items() if data}
    assert pa.total_allocated_bytes() < 1 << 30
