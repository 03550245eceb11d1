"""Statistics of whole texts, for whole Arrow batches at once: numpy passes over the UTF-8 bytes, no loop over words.

Words are runs of characters other than space and the five controls from tab to carriage return. Words, lines and
word windows are compared by 64-bit hashes (a running polynomial of random byte values, finally mixed).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, text_or_empty
from .files import release_memory
from .tokens import text_buffers

SLICE_BYTES = 1 << 19
WINDOW = 5
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE = _set(b" \t\n\x0b\x0c\r")
_SYMBOL = _set(b"#*$%&|<>")
_UPPER, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(48, 58)))
_PUNCT = _set(b".,;:!?")
_STOP = _set(b".!?")
_CONT = np.array([0x80 <= b < 0xC0 for b in range(256)])
_LETTER = _set(bytes(range(65, 91)) + bytes(range(97, 123))) | np.array([b >= 0xC0 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        if n > 8 * SLICE_BYTES:  # one very long text: not kept
            return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BASE_INV))
        for k, b in enumerate((_BASE, _BASE_INV)):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Documents first to last of a text column, about ``limit`` bytes at a time: (first, last, bytes, offsets)."""
    data, offsets = text_buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Slice:
    """Texts laid out with a line end before, between and after them, with the running hash of their bytes."""

    data: np.ndarray
    seps: np.ndarray
    n: int

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Slice:
        n = len(offsets) - 1
        seps = offsets + np.arange(n + 1)
        padded = np.full(len(data) + n + 1, 10, np.uint8)
        own = np.ones(len(padded), bool)
        own[seps] = False
        padded[own] = data
        out = cls(padded, seps, n)
        power, out.inverse = _powers(len(padded) + 1)
        out.running = np.zeros(len(padded) + 1, np.uint64)
        np.cumsum(_BYTE[padded] * power[: len(padded)], out=out.running[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.running[ends] - self.running[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.seps, at, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of all words."""
        edge = np.flatnonzero(np.diff(_SPACE[self.data])) + 1
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, self.doc_of(starts)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each document, how many of its bytes are flagged."""
        upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return upto[self.seps[1:]] - upto[self.seps[:-1] + 1]


def windows(hashes: np.ndarray, doc: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of ``size`` words that lies in one document."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    out = np.zeros(len(first), np.uint64)
    for k in range(size):
        out += hashes[first + k] * _STEP[k]
    return first, mix(out)


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1)))


def _extra_copies(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document, rows whose key an earlier row has."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    return np.bincount(doc[order[1:][same]], minlength=n)


#: The statistics in order: the contract's first, then the others that models use.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_letters", "n_punct", "n_upper_words", "n_stop_ends", "n_long_words", "n_chars_all", "n_bars", "n_bangs", "n_bullets"]


def statistics(column: pa.Array) -> np.ndarray:
    """[document, statistic] of a batch of texts, in the order of :data:`COUNTS`."""
    out = np.zeros((len(column), len(COUNTS)), np.int64)
    for first, last, data, offsets in slices(column):
        s = Slice.of(data, offsets)
        starts, ends, doc = s.words()
        n, b = s.n, s.data
        word = s.hashes(starts, ends)
        rows = out[first:last]
        rows[:, 0] = np.bincount(doc, minlength=n)
        visible = ~_CONT[b]
        rows[:, 14] = s.sums(visible)
        rows[:, 1] = s.sums(visible & ~_SPACE[b])
        rows[:, 2] = s.sums(_SYMBOL[b])
        # Lines: the seps are line ends too.
        breaks = np.flatnonzero(b == 10)
        at, to = breaks[:-1] + 1, breaks[1:]
        line_doc = s.doc_of(breaks[:-1])
        shown = np.concatenate([[0], np.cumsum(~_SPACE[b])])
        full = shown[to] > shown[at]
        at, to, line_doc = at[full], to[full], line_doc[full]
        rows[:, 5] = np.bincount(line_doc, minlength=n)
        rows[:, 3] = _extra_copies(_in_doc(s.hashes(at, to), line_doc), line_doc, n)
        rows[:, 12] = np.bincount(line_doc, weights=_STOP[b[to - 1]], minlength=n)
        rows[:, 17] = np.bincount(line_doc, weights=(b[at] == 45) | (b[at] == 42), minlength=n)
        gram, key = windows(word, doc)
        key = _in_doc(key, doc[gram])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        cover = np.zeros(len(word) + WINDOW + 1, np.int64)
        np.add.at(cover, gram[again], 1)
        np.add.at(cover, gram[again] + WINDOW, -1)
        covered = np.cumsum(cover)[: len(word)] > 0
        rows[:, 4] = np.bincount(doc, weights=covered, minlength=n)
        rows[:, 6] = rows[:, 0] - _extra_copies(_in_doc(word, doc), doc, n)
        for k, flags in ((7, _UPPER), (8, _DIGIT), (9, _LETTER), (10, _PUNCT)):
            rows[:, k] = s.sums(flags[b])
        upper = np.concatenate([[0], np.cumsum(_UPPER[b])])
        size = ends - starts
        rows[:, 11] = np.bincount(doc, weights=(upper[ends] - upper[starts] >= 2), minlength=n)
        rows[:, 13] = np.bincount(doc, weights=size > 20, minlength=n)
        rows[:, 15] = s.sums(b == 124)
        rows[:, 16] = s.sums(b == 33)
    return out


#: What models see: sizes on a log scale and shares, so that a text's length alone doesn't carry the rest.
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "words_a_line", "distinct_share", "upper_share", "digit_share", "letter_share", "punct_share", "upper_word_share", "stop_end_share", "long_word_share", "bar_share", "bang_share", "bullet_share"]


def features(counts: np.ndarray) -> np.ndarray:
    """[document, feature] from the counts; an empty text has zeros."""
    c = counts.astype(np.float64)
    words, lines, chars = np.maximum(c[:, 0], 1), np.maximum(c[:, 5], 1), np.maximum(c[:, 1], 1)
    cols = [np.log1p(c[:, 0]), c[:, 1] / words, c[:, 2] / chars, c[:, 3] / lines, c[:, 4] / words, np.log1p(c[:, 0] / lines), c[:, 6] / words, c[:, 7] / chars, c[:, 8] / chars, c[:, 9] / chars, c[:, 10] / words, c[:, 11] / words, c[:, 12] / lines, c[:, 13] / words, c[:, 15] / words, c[:, 16] / words, c[:, 17] / lines]
    return np.round(np.stack(cols, axis=1), 9)


def with_statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Adds the counts and features of ``text`` (null: empty) under free names; returns them by their plain names."""
    names = {}
    wide = df
    for name in (*COUNTS, *FEATURES):
        names[name] = free_name(wide, name)
        kind = "long" if name in COUNTS else "double"
        wide = wide.withColumn(names[name], F.lit(None).cast(kind))
    schema, plain = wide.schema, free_name(wide, "_text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = statistics(batch.column(batch.num_columns - 1))
            shares = features(counts)
            columns = batch.columns[:-1] + [pa.array(counts[:, k]) for k in range(len(COUNTS))] + [pa.array(shares[:, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
        release_memory()

    return df.select(*[col(c) for c in df.columns], text_or_empty(text).alias(plain)).mapInArrow(add, schema), names
