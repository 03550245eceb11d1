"""Whole-text byte-BPE encoding for Arrow batches, with a vectorised memo of encoded pieces.

A byte-level BPE vocabulary first cuts a text by a pattern (letter runs, digit runs, symbol runs, each with at
most one leading space, and white space) and then merges inside each cut piece. Pieces are therefore independent,
and a piece has the same ids wherever it stands. :class:`PieceEncoder` cuts only where the pattern is sure to cut,
gives each piece a 64-bit hash with one pass of numpy over the bytes, and lets the ``tokenizers`` library encode each
piece it has not met before. Where a cut is unsure (apostrophes, runs of white space, letters beyond Latin-1), the
piece just gets longer, so the ids always equal those of encoding the whole text at once. The file's added tokens are
found first, as the library does; what stands between them is cut as if it were a text of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

END_ID = 2
#: A batch is encoded in slices of about this many bytes, so numpy's work arrays stay small.
SLICE_BYTES = 1 << 20
#: Memo entries kept in one worker; at about 40 bytes each this bounds the memo to 120 MB.
MEMO_ENTRIES = 3_000_000

_LETTER, _DIGIT, _SYMBOL, _QUOTE, _SPACE, _WHITE, _HIGH, _SEP = range(8)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _HIGH, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if b == 0x20 else _QUOTE if c == "'" else _SYMBOL if 0x21 <= b < 0x7F else _HIGH
    kind[[0x09, 0x0A, 0x0D]] = _WHITE  # other controls stay unsure
    kind[0xFF] = _SEP  # never in UTF-8; put between documents
    return kind


_KIND = _byte_classes()
_SURE = np.isin(np.arange(8), [_LETTER, _DIGIT, _SYMBOL, _QUOTE])


def _cut_table() -> np.ndarray:
    """[before, at] -> the pattern always cuts between these two classes."""
    cut = np.zeros((8, 8), bool)
    cut[_LETTER, [_DIGIT, _SYMBOL, _QUOTE, _WHITE, _SPACE]] = True
    cut[_DIGIT, [_LETTER, _SYMBOL, _QUOTE, _WHITE, _SPACE]] = True
    cut[_SYMBOL, [_LETTER, _DIGIT, _WHITE, _SPACE]] = True
    cut[_QUOTE, [_DIGIT, _WHITE, _SPACE]] = True
    cut[_SEP, :] = cut[:, _SEP] = True
    return cut


_CUT = _cut_table()
_RNG = np.random.default_rng(20240229)
_BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class PieceEncoder:
    """Encodes batches of whole texts with a ``tokenizers`` file; see the module's docstring."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = {t.content.encode(): (i, t) for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.content}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        self._added = {content: i for content, (i, _) in added.items()}
        self._any_added = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if added else None
        self._limit = memo_entries
        (self._newline,) = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._power, self._inverse = _powers(_BASE, SLICE_BYTES + 64), _powers(_BASE_INV, SLICE_BYTES + 64)
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int32)
        self._ids = np.zeros(0, np.uint16 if self._tokenizer.get_vocab_size() <= 65536 else np.uint32)
        self._used = 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the count of each text."""
        data, offsets = text_buffers(column)
        starts, ends, added = self._find_added(data, offsets)
        if not len(added):
            return self._encode(data, offsets)
        # What stands between the added tokens is encoded as texts of their own, then the tokens are put between them.
        n = len(offsets) - 1
        doc = np.searchsorted(offsets, starts, "right") - 1
        gone = np.concatenate([[0], np.cumsum(ends - starts)])
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        cuts = np.concatenate([offsets - gone[np.searchsorted(starts, offsets, "left")], starts - gone[:-1]])
        ids, counts = self._encode(data[np.cumsum(inside)[:-1] == 0], np.sort(cuts))
        ids = np.insert(ids, np.cumsum(counts)[doc + np.arange(len(doc))], added)
        owner = np.repeat(np.arange(n), 1 + np.bincount(doc, minlength=n))
        return ids, np.bincount(owner, weights=counts, minlength=n).astype(np.int64) + np.bincount(doc, minlength=n)

    def _find_added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of the added tokens in the texts."""
        raw = data.tobytes()
        found = []
        if self._any_added and any(x in raw for x in self._added):
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found += [(m.start(), m.end(), self._added[m[0]]) for m in self._any_added.finditer(raw, i, j)]
        return tuple(np.array(found, np.int64).reshape(-1, 3).T)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(offsets) - 1, np.int64)
        found, first = [], 0
        while first < len(counts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
            if last == first + 1 and offsets[last] - offsets[first] > SLICE_BYTES:
                parts = [self._slice(x, np.array([0, len(x)]))[0] for x in self._segments(data[offsets[first] : offsets[last]])]
                counts[first] = sum(map(len, parts))
                found += parts
            else:
                ids, n = self._slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                counts[first:last] = n
                found.append(ids)
            first = last
        return (np.concatenate(found) if found else np.zeros(0)).astype(np.uint32), counts

    def _segments(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in parts that begin with a space between two ASCII letters, where the pattern always cuts."""
        while len(data) > SLICE_BYTES:
            kind = _KIND[data[: SLICE_BYTES + 1]]
            sure = np.flatnonzero((kind[1:-1] == _SPACE) & (kind[:-2] == _LETTER) & (kind[2:] == _LETTER))
            if not len(sure):  # one unbroken run: look for the first sure place after it
                kind = _KIND[data]
                sure = np.flatnonzero((kind[1:-1] == _SPACE) & (kind[:-2] == _LETTER) & (kind[2:] == _LETTER))[:1]
                if not len(sure):
                    break
            cut = int(sure[-1]) + 1
            yield data[:cut]
            data = data[cut:]
        yield data

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        padded = np.full(len(data) + n + 1, 0xFF, np.uint8)
        text = np.ones(len(padded), bool)
        text[offsets + np.arange(n + 1)] = False
        padded[text] = data
        kind = _KIND[padded]
        # Latin-1 letters are two bytes: C3 and any but the multiplication and division signs.
        lead = np.flatnonzero(padded[:-1] == 0xC3)
        lead = lead[(padded[lead + 1] != 0x97) & (padded[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        cut = np.zeros(len(padded), bool)
        cut[1:] = _CUT.ravel()[kind[:-1].astype(np.uint8) * np.uint8(8) + kind[1:]]
        cut[0] = True
        # A space just before a visible character belongs to it, whatever stands before the space.
        space = np.flatnonzero(kind[:-1] == _SPACE)
        cut[space[_SURE[kind[space + 1]]]] = True
        # One tab or line end between two visible characters is a piece of its own.
        white = np.flatnonzero(kind[1:-1] == _WHITE) + 1
        white = white[_SURE[kind[white + 1]] & (_SURE[kind[white - 1]] | (kind[white - 1] == _SEP))]
        cut[white + 1] = True
        starts = np.flatnonzero(cut)
        sep = kind[starts] == _SEP
        ends = np.append(starts[1:], len(padded))
        doc = np.cumsum(sep)[~sep] - 1
        starts, ends = starts[~sep], ends[~sep]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        size = len(padded) + 1
        power, inverse = (self._power, self._inverse) if size <= len(self._power) else (_powers(_BASE, size), _powers(_BASE_INV, size))
        running = np.zeros(size, np.uint64)
        np.cumsum(_BYTE_HASH[padded] * power[: size - 1], out=running[1:])
        key = _mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        where = self._look_up(key, starts, ends, padded)
        at, length = self._at[where], self._len[where].astype(np.int64)
        upto = np.cumsum(length)
        ids = self._ids[np.repeat(at - (upto - length), length) + np.arange(upto[-1])]
        counts = np.bincount(doc, weights=length, minlength=n).astype(np.int64)
        return ids, counts

    def _look_up(self, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        unique, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self._hashes) > self._limit:
            self._forget()
        place = np.searchsorted(self._hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self._hashes)
        known[inside] = self._hashes[place[inside]] == unique[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            self._learn(unique[new], starts[first[new]], ends[first[new]], data)
            place = np.searchsorted(self._hashes, unique)
        return place[inverse]

    def _learn(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> None:
        """Has the library encode pieces that are new: most of them in one text, a line each."""
        raw = data.tobytes()
        pieces = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        kind = _KIND[data]
        odd = (kind >= _SPACE) & (kind != _SPACE) & (kind != _HIGH)
        running = np.concatenate([[0], np.cumsum(odd)])
        # A line holds a piece alone if no white space but one leading space, and no unsure character, is in it.
        spaces = np.concatenate([[0], np.cumsum(kind == _SPACE)])
        high = np.concatenate([[0], np.cumsum((kind == _HIGH) & (data < 0x80) | np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3]))])
        inner = np.minimum(starts + 1, ends)
        plain = (running[ends] == running[starts]) & (spaces[ends] == spaces[inner]) & (high[ends] == high[starts]) & ((kind[starts] != _SPACE) | (ends - starts > 1))
        ids, lengths = [], np.zeros(len(keys), np.int32)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain = int(plain.sum())
        for i in range(0, n_plain, 20_000):
            part = order[i : min(i + 20_000, n_plain)]
            (found,) = self._tokenizer.encode_batch_fast(["\n".join([pieces[k] for k in part.tolist()])], add_special_tokens=False)
            found = np.array(found.ids, self._ids.dtype)
            stops = np.flatnonzero(found == self._newline)
            if len(stops) != len(part) - 1:
                raise RuntimeError("a piece was not encoded on its own")
            lengths[part] = np.diff(np.concatenate([[-1], stops, [len(found)]])) - 1
            ids.append(found[found != self._newline])
        rest = order[n_plain:].tolist()
        for i in range(0, len(rest), 1000):
            for k, x in zip(rest[i : i + 1000], self._tokenizer.encode_batch_fast([pieces[k] for k in rest[i : i + 1000]], add_special_tokens=False), strict=True):
                lengths[k] = len(x.ids)
                ids.append(np.array(x.ids, self._ids.dtype))
        flat = np.concatenate(ids)
        at = np.zeros(len(keys), np.int64)
        at[order] = np.cumsum(lengths[order]) - lengths[order] + self._used
        if self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids[: self._used], flat, np.zeros(len(flat) + self._used // 2, self._ids.dtype)])
        else:
            self._ids[self._used : self._used + len(flat)] = flat
        self._used += len(flat)
        place = np.searchsorted(self._hashes, keys)
        self._hashes, self._at, self._len = np.insert(self._hashes, place, keys), np.insert(self._at, place, at), np.insert(self._len, place, lengths)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The process-wide encoder of a vocabulary file, so its memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each text, and the n + 1 offsets of the texts."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(offsets[-1], end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[offsets[1:] - 1] = False
    out[own] = ids
    return out, offsets


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
