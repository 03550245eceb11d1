"""Vector bin packing of examples into training sequences under limits on tokens, segments and loss-bearing tokens.

An example is a run of ids whose first ``tokens - loss`` ids are a prompt that bears no loss. Whole sequences are cut off long
examples where they are encoded; what is left of them, and all shorter examples, are dealt evenly over tasks as one row each with
their ids. A task packs its rows in blocks of bounded size. It fills one sequence at a time: of all examples that fit what is left
of the three limits it takes the one whose demand has the greatest dot product with what is left, both measured against
the limits (:func:`fill`). When none fits, the head of an example is cut off to fill the sequence, and the rest goes back; where
the segments or the loss are used up before the tokens, the sequence is cut back to a power of two. So no sequence but a
power of two is short of ``tokens``, and nothing is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, row_hash, text_or_empty
from .files import release_memory
from .tokens import default_vocabulary, encoder, with_end

END_ID = 0
#: Examples that a task packs together, and how few of them may wait for the next ones before more are read.
BLOCK, LOW = 8192, 2048


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. A loss limit of at least ``tokens`` leaves it to the tokens."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("each limit must be at least 1")


class Pool:
    """Open pieces by demand (tokens, loss), as arrays for the dot products and a stack of pieces for each demand."""

    def __init__(self, capacity: int = 1024):
        self.tokens, self.loss, self.count = (np.zeros(capacity, np.int64) for _ in range(3))
        self._at: dict[tuple[int, int], int] = {}
        self._held: list[list[tuple[int, int]]] = []
        self.size = 0

    def put(self, item: int, start: int, tokens: int, loss: int) -> None:
        k = self._at.setdefault((tokens, loss), len(self._held))
        if k == len(self._held):
            if k == len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.loss, self.count))
            self.tokens[k], self.loss[k] = tokens, loss
            self._held.append([])
        self._held[k].append((item, start))
        self.count[k] += 1
        self.size += 1

    def take(self, k: int) -> tuple[int, int, int, int]:
        """(item, start, tokens, loss) of a piece with demand ``k``."""
        self.count[k] -= 1
        self.size -= 1
        return *self._held[k].pop(), int(self.tokens[k]), int(self.loss[k])

    def fitting(self, tokens: int, loss: int, limits: Limits) -> int:
        """The demand that fits and has the greatest dot product with what is left, or -1. Segments add the same to each."""
        n = len(self._held)
        t, x = self.tokens[:n], self.loss[:n]
        product = t * (tokens * limits.loss**2) + x * (loss * limits.tokens**2)
        product[(self.count[:n] == 0) | (t > tokens) | (x > loss)] = -1
        k = int(product.argmax())
        return k if product[k] >= 0 else -1

    def longest_head(self, tokens: int, loss: int) -> tuple[int, int]:
        """The demand with the longest head that fits, of these the one with most tokens, and the head's length."""
        n = len(self._held)
        t = self.tokens[:n]
        head = np.minimum(np.minimum(t, tokens), t - self.loss[:n] + loss)
        head[self.count[:n] == 0] = 0
        k = int((head * (1 << 32) + t).argmax())
        return k, int(head[k])


Piece = tuple[int, int, int, int]


def _cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    """A piece (item, start, tokens, loss) as its first ``at`` ids and the rest."""
    item, start, tokens, loss = piece
    kept = max(0, at - (tokens - loss))
    return (item, start, at, kept), (item, start + at, tokens - at, loss - kept)


def fill(pool: Pool, limits: Limits, last: bool, low: int = LOW) -> Iterator[list[Piece]]:
    """Sequences of pieces from ``pool``, until it is empty, or, unless they are the ``last``, few are left."""
    while pool.size > (0 if last else low):
        tokens, segments, loss = limits.tokens, limits.segments, limits.loss
        own: list[Piece] = []
        while tokens and segments and pool.size:
            k = pool.fitting(tokens, loss, limits)
            if k >= 0:
                piece = pool.take(k)
            else:
                k, head = pool.longest_head(tokens, loss)
                if not head:
                    break
                piece, rest = _cut(pool.take(k), head)
                pool.put(*rest)
            own.append(piece)
            tokens, segments, loss = tokens - piece[2], segments - 1, loss - piece[3]
        if tokens and not last and not pool.size:  # it may still be filled with what comes
            for piece in own:
                pool.put(*piece)
            return
        if tokens:
            over = limits.tokens - tokens
            over -= 1 << over.bit_length() - 1
            while over:
                piece = own.pop()
                if piece[2] > over:
                    piece, rest = _cut(piece, piece[2] - over)
                    own.append(piece)
                    pool.put(*rest)
                    break
                pool.put(*piece)
                over -= piece[2]
        yield own


_OPEN = "doc_id long, key long, start long, length long, doc_tokens long, loss long, ids_crc32 long, ids binary"
_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def _encoded(path: str, limits: Limits, end_id: int):
    """Texts as pieces: whole sequences with their checksum, and the rest with its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = encoder(path)
            ids, counts = own.encode(batch.column("text"))
            _, prompts = own.encode(batch.column("prompt"))
            ids, offsets = with_end(ids, counts, end_id)
            total = np.diff(offsets)
            size = limits.tokens
            n = (total + size - 1) // size
            doc = np.repeat(np.arange(len(total)), n)
            start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
            length = np.minimum(total[doc] - start, size)
            loss = np.clip(start + length - np.maximum(prompts[doc], start), 0, None)
            whole = (length == size) & (loss <= limits.loss)
            at = offsets[:-1][doc] + start
            crc = [zlib.crc32(ids[a : a + m]) if w else None for a, m, w in zip(at.tolist(), length.tolist(), whole.tolist(), strict=True)]
            narrow = ids.astype("<u2") if not len(ids) or int(ids.max()) < 1 << 16 else ids.astype("<u4")
            raw = [None if w else narrow[a : a + m].tobytes() for a, m, w in zip(at.tolist(), length.tolist(), whole.tolist(), strict=True)]
            where = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(where), batch.column("key").take(where), pa.array(start), pa.array(length), pa.array(total[doc]), pa.array(loss), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "key", "start", "length", "doc_tokens", "loss", "ids_crc32", "ids"],
            )
            release_memory()

    return encode


def _packer(limits: Limits, block: int, low: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        made = 0
        pool, held = Pool(), {}
        number = 0

        def packed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows = []
            for own in fill(pool, limits, last, low):
                offset = 0
                for item, start, tokens, loss in own:
                    doc_id, base, doc_tokens, ids = held[item]
                    crc = zlib.crc32(ids[start : start + tokens].astype("<u4"))
                    rows.append((doc_id, base + start, tokens, crc, doc_tokens, loss, first + made, offset))
                    offset += tokens
                made += 1
            if rows:
                yield batch_of(rows)
            still = {item for stack in pool._held for item, _ in stack}
            for item in held.keys() - still:
                del held[item]

        for batch in batches:
            whole = batch.filter(pa.compute.is_null(batch.column("ids")))
            if len(whole):
                n = len(whole)
                names = pa.array(np.arange(made, made + n) + first)
                made += n
                yield pa.RecordBatch.from_arrays([*[whole.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss")], names, pa.array(np.zeros(n, np.int64))], NAMES)
            rest = batch.filter(pa.compute.is_valid(batch.column("ids")))
            for doc_id, start, length, doc_tokens, loss, ids in zip(*[rest.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "loss", "ids")], strict=True):
                held[number] = doc_id, start, doc_tokens, np.frombuffer(ids, f"<u{len(ids) // length}")
                pool.put(number, 0, length, loss)
                number += 1
                if pool.size >= block:
                    yield from packed(False)
        yield from packed(True)
        release_memory()

    return pack


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES)


def pack_examples(docs: DataFrame, limits: Limits = Limits(), prompt: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, block: int = BLOCK, low: int = LOW) -> DataFrame:
    """Packs ``docs`` (doc_id, text): a row a piece with doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id and offset.

    ``prompt`` names a column with the text that stands before the answer in ``text`` (its beginning, word for word): as many ids as it
    has bear no loss, all others and the end id do. Without it all ids do. A sequence keeps all ``limits``; it has exactly
    ``limits.tokens`` ids or a power of two.

    Null and empty texts are the end id alone, null prompts are empty, a prompt with more ids than its text leaves no loss but the end id's.
    Null ids stay null; repeated rows are packed as often as they are stored, and which of them has which place is open; a rerun over the
    same files agrees. Other columns of ``docs`` go, whatever their names. An empty table gives an empty one. Rows are dealt
    evenly, so no key is hot; a task holds the ids of ``block`` examples of less than ``limits.tokens`` ids at most.
    """
    path = vocabulary or default_vocabulary()
    before = text_or_empty(prompt) if prompt else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("key"), text_or_empty().alias("text"), before.alias("prompt"))
    open_ = rows.mapInArrow(_encoded(path, limits, end_id), _OPEN)
    # Dealt by content, and in an order that content alone decides; a salt of places spreads rows that are equal throughout.
    salted = open_.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    dealt = salted.repartition(parts_for(docs), "key", "start", "_salt").sortWithinPartitions(F.xxhash64("key", "start", "_salt"), "doc_id", "start")
    return dealt.drop("_salt").mapInArrow(_packer(limits, block, low), _PACKED)
