"""Best-fit packing of token pieces into sequences of a fixed length, in bulk-synchronous rounds.

Open pieces and the gaps of sequences are range-sorted together by length, longest first, into cells of bounded size
(:func:`cells`). A round is a sweep: each cell lets its pieces, longest first, take the smallest of its gaps that
holds them, and hands on what finds none; pieces so left over then take their successors, gaps of the nearest cells
above, and as many pieces may want one gap, they are told apart by rank (:func:`successors`). The gaps are updated,
take their new place in the order, and the next round begins. A piece opens a sequence only if it is among the
longest open ones and longer than what gaps are left. There are several cells until a few hundred rows are open; these are one cell,
and the last round is best fit itself. The driver sees counts by length and by cell; pieces and gaps are narrow rows that are only sorted,
matched and joined in tasks of bounded size.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, row_hash, text_or_empty
from .files import release_memory
from .tokens import default_vocabulary, encoder, with_end

SEQUENCE = 1024
PIECES = "doc_id long, _h long, piece int, start long, length long, ids_crc32 long"
#: Rows of a cell, unless that made more than ``CELLS`` cells; then cells are larger.
CELL_ROWS, CELLS = 50_000, 50_000
#: There are so many cells at least, until no more than so many rows are open.
LEAST_CELLS, LAST_ROWS = 8, 512
#: Gaps that hold the longest open pieces keep them from opening sequences, unless they are fewer than this share of them.
FEW_GAPS = 0.001


def tokenized_pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Documents (doc_id, text) as pieces of at most ``size`` ids; only longer documents are cut, their first piece takes the remainder."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = encoder(path).encode(batch.column("text"))
            ids, offsets = with_end(ids, counts)
            total = np.diff(offsets)
            n = (total + size - 1) // size
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = total - (n - 1) * size
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * size)
            length = np.where(piece == 0, first[doc], size)
            at = offsets[:-1][doc] + start
            crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            where = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(where), batch.column("_h").take(where), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "_h", "piece", "start", "length", "ids_crc32"],
            )
            release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs).alias("_h"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Cells:
    """The cell of a row of length n is first[n] plus its hash modulo parts[n]; cell numbers rise as lengths fall."""

    first: list[int]
    parts: list[int]
    least: list[int]
    """The least length of each cell."""


def cells(counts: dict[int, int], size: int, most: int = CELL_ROWS) -> Cells:
    """Ranges of lengths with about ``most`` rows each, but ``LEAST_CELLS`` while more than ``LAST_ROWS`` are open; a length with more rows is dealt over several cells."""
    rows = sum(counts.values())
    most = max(min(most, -(-rows // LEAST_CELLS)) if rows > LAST_ROWS else most, -(-rows // CELLS))
    first, parts, least, rows = [0] * (size + 1), [1] * (size + 1), [], 0
    for n in sorted(counts, reverse=True):
        if not least or rows + counts[n] > most:
            parts[n] = max(1, -(-counts[n] // most))
            least += [n] * parts[n]
            first[n], rows = len(least) - parts[n], counts[n] if parts[n] == 1 else most
        else:
            first[n], least[-1], rows = len(least) - 1, n, rows + counts[n]
    return Cells(first, parts, least)


def best_fit(lengths: list[int], pieces: list[int], gaps: list[tuple[int, int]], size: int, opens: int) -> tuple[list[tuple[int, int, int]], list[int], list[tuple[int, int]]]:
    """Best fit within a cell: (places, indexes of pieces without one, gaps left).

    ``lengths`` descend. Each piece takes the smallest gap (length, sequence) that holds it; without one it opens a
    sequence of its own name if it is longer than ``opens``. A place is (index, sequence, offset).
    """
    held: dict[int, list[int]] = {}
    sizes: list[int] = []  # the lengths of gaps there are, ascending

    def put(gap: int, sequence: int) -> None:
        if gap:
            if gap not in held:
                held[gap] = []
                bisect.insort(sizes, gap)
            held[gap].append(sequence)

    for gap, sequence in gaps:
        put(gap, sequence)
    places, left = [], []
    for k, (length, piece) in enumerate(zip(lengths, pieces, strict=True)):
        at = bisect.bisect_left(sizes, length)
        if at < len(sizes):
            gap = sizes[at]
            sequence = held[gap].pop()
            if not held[gap]:
                del held[gap]
                sizes.pop(at)
        elif length > opens:
            gap, sequence = size, piece
        else:
            left.append(k)
            continue
        places.append((k, sequence, size - gap))
        put(gap - length, sequence)
    return places, left, [(g, x) for g in sizes for x in held[g]]


def successors(summary: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Whom the pieces that a cell hands on take: (cell, from rank, to rank, cell of the gaps, first gap's rank, pieces a gap).

    ``summary`` has (cell, pieces left, longest of them, gaps left, least of them) in the order of cells. The nearest
    cell above that still has gaps is served first; its gaps all hold as many of the longest piece as the least does.
    """
    free: list[list[int]] = []
    out = []
    for cell, n, longest, n_gaps, least in summary:
        rank = 0
        while rank < n and free:
            above, first, count, gap = free[-1]
            each = gap // longest
            take = min(count, -(-(n - rank) // each))
            upto = min(n, rank + take * each)
            out.append((cell, rank, upto, above, first, each))
            rank = upto
            if take == count:
                free.pop()
            else:
                free[-1] = [above, first + take, count - take, gap]
        if n_gaps:
            free.append([cell, 0, n_gaps, least])
    return out


def opening_bar(longest: int, size: int) -> int:
    """Only pieces longer than this open sequences in a round whose longest piece is given.

    If m of the longest fill a sequence, then what m pieces longer than size / (m + 1) leave of one holds no other
    such piece, so none of them loses a gap by opening at once. Short pieces waste little, so their ranges are wider.
    """
    m = size // longest
    return size // (m + 1) if m < 4 else longest * 3 // 4


#: What a row of a sweep is: a place found, an open piece, a gap that may be taken from below, a gap that waits for the next round.
PLACE, PIECE, GAP, LATER = range(4)
_SWEPT = "cell int, kind int, id long, n int, rank int, sequence long, offset int"


def _swept(rows: DataFrame, plan: Cells, size: int, opens: int) -> DataFrame:
    """Each cell's best fit: its places, and the pieces and gaps left with their ranks."""
    least = plan.least

    def sweep(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        gap, n, name = (table.column(c).to_numpy() for c in ("gap", "n", "id"))
        own = np.lexsort((name, -n))
        own = own[~gap[own]]
        free = np.lexsort((name, n))
        free = free[gap[free]]
        lengths, pieces = n[own].tolist(), name[own].tolist()
        places, left, gaps = best_fit(lengths, pieces, list(zip(n[free].tolist(), name[free].tolist(), strict=True)), size, opens)
        ready = [g for g in gaps if g[0] >= least[cell]]
        later = [g for g in gaps if g[0] < least[cell]]
        parts = [
            [(PLACE, pieces[k], lengths[k], None, x, at) for k, x, at in places],
            [(PIECE, pieces[k], lengths[k], r, None, None) for r, k in enumerate(left)],
            [(GAP, x, g, r, None, None) for r, (g, x) in enumerate(ready)],
            [(LATER, x, g, None, None, None) for g, x in later],
        ]
        columns = list(zip(*[x for p in parts for x in p], strict=True)) or [()] * 6
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.Table.from_arrays([pa.array(np.full(len(arrays[0]), cell, np.int32)), *arrays], ["cell", "kind", "id", "n", "rank", "sequence", "offset"])

    of = lambda x: F.get(F.array(*map(F.lit, x)), F.col("n"))
    dealt = rows.withColumn("cell", (of(plan.first) + F.pmod(F.xxhash64("id"), of(plan.parts))).cast("int"))
    return dealt.select("cell", "gap", "id", "n").groupBy("cell").applyInArrow(sweep, _SWEPT)


def places(open_: DataFrame, size: int = SEQUENCE, cell_rows: int = CELL_ROWS) -> DataFrame | None:
    """(id, sequence, offset) for pieces (id, n) of lengths 1 to ``size``, or None without pieces."""
    spark = open_.sparkSession
    rows, found = open_.select(F.lit(False).alias("gap"), "id", F.col("n").cast("int").alias("n")), None
    while True:
        counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
        for r in rows.groupBy("gap", "n").agg(F.count(F.lit(1)).alias("rows")).collect():  # at most two a length
            counts[r.gap][r.n] = r.rows
        pieces, gaps = counts[False], counts[True]
        if any(not 1 <= n <= size for n in pieces):
            raise ValueError(f"lengths must be 1 to {size}")
        if not pieces:
            return found
        shortest, longest = min(pieces), max(pieces)
        gaps = {n: k for n, k in gaps.items() if n >= shortest}  # what holds no piece is done
        plan = cells({n: pieces.get(n, 0) + gaps.get(n, 0) for n in pieces | gaps}, size, cell_rows)
        bar, spared = 0, FEW_GAPS * sum(pieces.values())
        for n in sorted(gaps, reverse=True):  # the length that all but a few gaps don't exceed
            spared -= gaps[n]
            if spared < 0:
                bar = n
                break
        opens = 0 if len(plan.least) == 1 else max(bar, opening_bar(longest, size))
        swept = materialize(_swept(rows.where(~F.col("gap") | (F.col("n") >= shortest)), plan, size, opens), "swept")
        left, free = F.col("kind") == PIECE, F.col("kind") == GAP
        ends = swept.where(left | free).groupBy("cell").agg(F.count_if(left).alias("p"), F.max(F.when(left, F.col("n"))).alias("longest"), F.count_if(free).alias("g"), F.min(F.when(free, F.col("n"))).alias("least"))
        summary = sorted((r.cell, r.p, r.longest or 0, r.g, r.least or 0) for r in ends.collect())  # a row a cell
        new = swept.where(F.col("kind") == PLACE).select("id", "sequence", "offset")
        state = swept.where(F.col("kind") != PLACE).select((F.col("kind") != PIECE).alias("gap"), "id", "n")
        if runs := successors(summary):  # at most two a cell
            whom = spark.createDataFrame(runs, "p_cell int, p_from int, p_to int, g_cell int, g_first int, each int")
            wanted = swept.where(left).join(F.broadcast(whom), (F.col("cell") == F.col("p_cell")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
            wanted = wanted.select("id", "n", F.col("rank").alias("r"), F.col("g_cell").alias("cell"), (F.col("g_first") + F.expr("(rank - p_from) div each")).cast("int").alias("rank"))
            in_gap = Window.partitionBy("cell", "rank").orderBy("r")
            taken = wanted.join(swept.where(free).select("cell", "rank", F.col("id").alias("sequence"), F.col("n").alias("gap")), ["cell", "rank"])
            taken = taken.withColumn("before", F.coalesce(F.sum("n").over(in_gap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            taken = materialize(taken.select("id", "n", "sequence", (size - F.col("gap") + F.col("before")).cast("int").alias("offset")), "taken")
            less = taken.select(F.lit(True).alias("gap"), F.col("sequence").alias("id"), (-F.col("n")).alias("n")).unionByName(taken.select(F.lit(False).alias("gap"), "id", (-F.col("n")).alias("n")))
            state = state.unionByName(less).groupBy("gap", "id").agg(F.sum("n").cast("int").alias("n")).where("n > 0")
            new = new.unionByName(taken.select("id", "sequence", "offset"))
        rows = materialize(state, "open")
        found = new if found is None else found.unionByName(new)


def pack(pieces: DataFrame, size: int = SEQUENCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, which need ``length`` (1 to ``size``).

    ``pieces`` must be stored rows (read more than once) that give the same order of rows each time. A sequence has
    the number of the piece that opened it. Equal rows are told apart by their place in storage alone. Reruns over
    the same files agree. An empty table stays empty; all columns of ``pieces`` stay, whatever their names.
    """
    name, sequence, offset = (free_name(pieces, x) for x in ("_piece", "sequence_id", "offset"))
    stored = materialize(pieces.withColumn(name, F.monotonically_increasing_id()), "numbered")
    found = places(stored.where(F.col("length") < size).select(F.col(name).alias("id"), F.col("length").alias("n")), size, cell_rows)
    if stored.where((F.col("length") > size) | F.col("length").isNull()).limit(1).count():
        raise ValueError(f"lengths must be 1 to {size}")
    whole = stored.where(F.col("length") == size).withColumn(sequence, F.col(name)).withColumn(offset, F.lit(0).cast("long"))
    if found is None:
        return whole.drop(name)
    put = found.select(F.col("id").alias(name), F.col("sequence").alias(sequence), F.col("offset").cast("long").alias(offset))
    return whole.unionByName(stored.where(F.col("length") < size).join(put, name)).drop(name)


def packed_documents(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Encodes, cuts and packs ``docs`` (doc_id, text): a row for each piece, with the columns doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty texts are one piece with the end id alone. Null ids stay null; repeated rows are packed as often as
    they are stored; other columns of ``docs`` go, as a piece is no document. An empty table gives an empty one.
    """
    return pack(tokenized_pieces(docs, size, vocabulary), size).drop("_h")
