"""Segments that meet no others take a short way, which gives what the general one does."""

import random

import pytest

from tidewire.operators.reassembly import Limits, Stream


class General(Stream):
    def _simple(self, at, data):
        return False


def seen(s):
    return s.base, s.done, [(at, bytes(d)) for at, d in s.waiting], bytes(s.ready), s.ready_total, s.held, s.overflow, s.state(), s.missing(), s.last_ts


def test_segments_in_order_or_behind_a_hole_are_not_placed(monkeypatch):
    monkeypatch.setattr(Stream, "_place", lambda *_: pytest.fail("placed"))
    s = Stream()
    got = [s.feed(q, b"x" * 10) for q in (0, 10, 30, 40, 20, 50)]
    assert got == [("in_order", 0), ("in_order", 0), ("buffered", 10), ("buffered", 20), ("in_order", 0), ("in_order", 0)]
    assert (s.done, s.held, s.ready_total, s.state()) == (60, 0, 60, "active")


def test_both_ways_agree():
    for seed in range(400):
        r = random.Random(seed)
        settings = Limits(r.choice([30, 100, 10**6]), r.choice([2, 3, 4096])), r.random() < 0.5, r.choice([None, 0, 7, 50])
        a, b, base = Stream(*settings), General(*settings), r.choice([5, 4294967290])
        for _ in range(40):
            data, at = r.randbytes(r.choice([0, 1, 3, 10, 20])), r.choice([a.done, a.done, r.randrange(200)])
            args = (base + at) & 0xFFFFFFFF, data, r.randrange(99), r.random() < 0.1, r.random() < 0.02, r.random() < 0.02
            assert a.feed(*args) == b.feed(*args) and seen(a) == seen(b)
