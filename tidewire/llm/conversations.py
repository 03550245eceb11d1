"""Conversations whose turns were damaged, brought back to legal roles by the cheapest edits.

A row's faults are told by expressions; of a conversation's rows a byte each goes through a graph whose nodes are (rows
consumed, what role may follow) and whose arcs are edits: Keep, Rerole, Delete and Insert. Minimum costs from the end, a number
of one small table a row, and from the start say which arcs are tight, which is that some cheapest repair has them. A walk from the
start keeps the set of nodes it may be in and takes the least letter among their tight arcs. Costs of nodes differ by little,
so vectors of costs repeat and each step is looked up. Texts are joined with the letters in the order of rows, as a stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Bytes of an output batch.
OUT_BYTES = 4 << 20

# What may follow: at the start system or user, after system only user, after user only assistant, after assistant user or the end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: Which node a kept row leads to, by its initial (s, u, a).
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
#: Where a turn that an edit chooses the role of leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED_COST = 1
FAR = 1 << 20
#: Nodes further than this above the cheapest are on no cheapest way: from each node any other's way can be followed for 3 + 2 + 2.
BEYOND = 8

Costs = tuple[int, int, int, int]


def _inserted(costs: list[int], back: bool) -> list[int]:
    """Costs when turns may be inserted, forward or seen from the end."""
    for _ in range(3):
        for v in range(4):
            if back:
                costs[v] = min(costs[v], costs[NEXT[v]] + COST["I"])
            else:
                costs[NEXT[v]] = min(costs[NEXT[v]], costs[v] + COST["I"])
    return costs


def _normal(costs: list[int]) -> tuple[Costs, int]:
    least = min(costs)
    return tuple(min(x - least, FAR) for x in costs), least


@lru_cache(None)
def arcs(code: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) over a row; ``code`` is its initial (s, u, a, other) plus 4 if it must go, 8 if it was truncated."""
    initial, kind = code & 3, code >> 2
    out = [("D", v, v, COST["D"]) for v in range(4)]
    if kind != 1:
        extra = TRUNCATED_COST * (kind == 2)
        out += [("K", v, w, COST["K"] + extra) for (v, x), w in KEPT.items() if x == initial]
        out += [("R", v, NEXT[v], COST["R"] + extra) for v in range(4)]
    return tuple(out)


END = _normal(_inserted([0 if v in FINAL else FAR for v in range(4)], True))
BEGIN = _normal(_inserted([0 if v == START else FAR for v in range(4)], False))[0]


@lru_cache(None)
def backward(after: Costs, code: int) -> tuple[Costs, int]:
    """Costs to the end before a row, less the least of them, from those after it."""
    costs = [FAR] * 4
    for _, v, w, c in arcs(code):
        costs[v] = min(costs[v], after[w] + c)
    return _normal(_inserted(costs, True))


@lru_cache(None)
def forward(before: Costs, code: int) -> Costs:
    costs = [FAR] * 4
    for _, v, w, c in arcs(code):
        costs[w] = min(costs[w], before[v] + c)
    return tuple(x if x <= BEYOND else FAR for x in _normal(_inserted(costs, False))[0])


@lru_cache(None)
def step(ahead: Costs, after: Costs | None, code: int, frontier: frozenset[int]) -> tuple[str, frozenset[int]]:
    """The least letters from the frontier until a row is consumed (after the last row: until the end), and the frontier then.

    ``ahead`` are minimum costs from the start, ``after`` those to the end beyond the row.
    """
    to_end, more = backward(after, code) if after is not None else END
    total = min(a + b for a, b in zip(ahead, to_end, strict=True))
    letters = ""
    while after is not None or not any(v in FINAL and ahead[v] == total for v in frontier):
        tight = [("I", w) for v in frontier for w in [NEXT[v]] if ahead[v] + COST["I"] + to_end[w] == total]
        if after is not None:
            tight += [(x, w) for x, v, w, c in arcs(code) if v in frontier and ahead[v] + c + after[w] == total + more]
        letter = min(x for x, _ in tight)
        letters += letter
        frontier = frozenset(w for x, w in tight if x == letter)
        if letter != "I":
            break
    return letters, frontier


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """The least cost and, of all edits that have it, the letters that are least as ASCII."""
    vectors, numbers, costs = array("H"), {END[0]: 0}, END[1]
    after = END[0]
    for code in reversed(codes):
        vectors.append(numbers.setdefault(after, len(numbers)))
        after, more = backward(after, code)
        costs += more
    costs += after[START]
    named = list(numbers)
    ahead, frontier, out = BEGIN, frozenset({START}), []
    for k, code in enumerate(codes, 1):
        letters, frontier = step(ahead, named[vectors[-k]], code, frontier)
        out.append(letters)
        ahead = forward(ahead, code)
    out.append(step(ahead, None, 0, frontier)[0])
    return costs, "".join(out)


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows after damage by crc32 of ``conv_id:turn``; a row with 0 copies was dropped and names its conversation.

    Nulls of role and text are one space, as are those of conv_id and turn in the key; conv_id and turn themselves stay null.
    """
    conv_id, turn, role, text = (_spaced(c) for c in ("conv_id", "turn", "role", "text"))
    what = F.crc32(F.concat(conv_id, F.lit(":"), turn)) % 20
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(what == 4, "user").otherwise(role).alias("role"),
        F.when(what == 1, "").when(what == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"),
    )


def _prepared(turns: DataFrame) -> DataFrame:
    """Rows with the columns that their order is told by: turn (nulls first), role, the text's first 64 characters, a digest of role and text."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    role, text = _spaced("role"), _spaced("text")
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]


#: What is told of a conversation; further columns follow it.
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _edits(schema: pa.Schema):
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, out, size = bytearray(), [], 0
        now, any_rows = None, False
        least = most = turn_before = digest_before = initial_before = None
        turns = blank = duplicate = truncated = illegal = 0

        def told() -> tuple:
            cost, audit = cheapest_edits(bytes(codes))
            gaps = most - least + 1 - turns if least is not None else 0
            return now, gaps, blank, duplicate, truncated, illegal, cost, audit

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv_id, turn, digest, initial, fault, later, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "initial", "fault", "later", "copies")], strict=True):
                if not any_rows or conv_id != now:
                    if any_rows:
                        out.append(told())
                        size += 100 + len(out[-1][-1])
                        if size > OUT_BYTES:
                            yield batch_of()
                            out, size = [], 0
                    any_rows, now = True, conv_id
                    codes.clear()
                    least = most = turn_before = digest_before = initial_before = None
                    turns = blank = duplicate = truncated = illegal = 0
                for _ in range(copies):
                    again = later or digest == digest_before
                    digest_before = digest
                    if turn is not None and turn != most:
                        turns, most = turns + 1, turn
                        least = turn if least is None else least
                    if initial_before is not None and (initial_before, initial) not in _LEGAL:
                        illegal += 1
                    initial_before = initial
                    if fault == BLANK:
                        blank += 1
                        codes.append(initial + 4)
                    elif again:
                        duplicate += 1
                        codes.append(initial + 4)
                    elif fault == TRUNCATED:
                        truncated += 1
                        codes.append(initial + 8)
                    else:
                        codes.append(initial)
        if any_rows:
            out.append(told())
        if out:
            yield batch_of()

    return edit


def repairs(turns: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each conversation of ``turns`` (conv_id, turn, role, text, and, if it has them, copies).

    A row a conv_id, null among them, with gaps, blank, duplicate, truncated, illegal, cost and audit. Nulls of role and text are one
    space. Rows go by turn (null first), then role, the text's first 64 characters and a digest; rows that are equal are copies, of
    which the first counts. ``copies`` tells how often a row is there, at once; a conversation without any has zeros and an
    empty audit. An empty table gives an empty one; other columns go, whatever their names.

    Rows are moved without their texts. Copies of a text meet by a digest of role and text, summed before they are
    shuffled; of a conversation its task holds a byte and a number of two bytes a row, as much as the audit has.
    """
    solid = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    finished = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    rows = _prepared(turns).select(
        "conv_id", "turn", "role", "head", "digest", "copies",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.when(~solid, BLANK).when(~finished, TRUNCATED).otherwise(0).alias("fault"),
    )
    there = rows.where((F.col("copies") > 0) & (F.col("fault") != BLANK)).groupBy("conv_id", "digest")
    firsts = there.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("null_first"), F.min("turn").alias("first")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("f_conv"), F.col("digest").alias("f_digest"), "null_first", "first")
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("digest") == F.col("f_digest")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("null_first") | (F.col("turn") > F.col("first"))), F.lit(False))
    marked = joined.select("conv_id", "turn", "role", "head", "digest", "copies", "initial", "fault", later.alias("later"))
    sorted_ = marked.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).drop("role", "head")
    schema = StructType([turns.schema["conv_id"], *[StructField(c, LongType()) for c in SUMMARY[:-1]], StructField("audit", StringType())])
    return sorted_.mapInArrow(_edits(to_arrow_schema(schema)), schema)


def _applied(turns: DataFrame) -> DataFrame:
    """In each partition whole conversations, one after the other: a row with the summary and no place, then its repaired turns."""
    told = repairs(turns)
    conv = turns.schema["conv_id"]
    texts = _prepared(turns).where("copies > 0")
    nothing = [F.lit(None).cast("long").alias(c) for c in SUMMARY[:-1]] + [F.lit(None).cast("string").alias("audit")]
    rows = texts.select("conv_id", F.lit(1).alias("mark"), "turn", "role", "head", "digest", "text", "copies", *nothing)
    marks = told.select("conv_id", F.lit(0).alias("mark"), *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in ("turn", "role", "head", "digest", "text", "copies")], *SUMMARY)
    both = rows.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "mark", *_order())
    schema = StructType([conv, StructField("place", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType()), *told.schema.fields[1:]])
    kinds = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, now = [], 0, None
        audit, at, place, node = "", 0, 0, START
        empty = (None,) * len(SUMMARY)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        def turn_of(letter: str, role: str, text: str) -> None:
            nonlocal place, node, size
            if letter == "K":
                node = KEPT[node, "sua".index(role[0])]
            else:
                node = NEXT[node]
                role = ROLE[node]
            out.append((now, place, letter, role, text, *empty))
            size += 100 + len(text)
            place += 1

        def inserted() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                turn_of("I", "", "")
                at += 1

        for batch in batches:
            for conv_id, mark, role, text, copies, *told in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "mark", "role", "text", "copies", *SUMMARY)], strict=True):
                if mark == 0:
                    inserted()
                    now, audit, at, place, node = conv_id, told[-1], 0, 0, START
                    out.append((now, None, None, None, None, *told))
                    size += 100 + len(audit)
                else:
                    for _ in range(copies):
                        inserted()
                        if audit[at] != "D":
                            turn_of(audit[at], role, text)
                        at += 1
                if size > OUT_BYTES:
                    yield batch_of()
                    out, size = [], 0
        inserted()
        if out:
            yield batch_of()

    return both.drop("head", "digest").mapInArrow(apply, schema)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (its letter), role and text, as :func:`repairs` defines them.

    A conversation of which nothing is left has no row.
    """
    return _applied(turns).where(F.col("place").isNotNull()).select("conv_id", "place", "edit", "role", "text")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """:func:`repairs` with ``repaired_sha256``, the digest of the repaired ``role:text`` rows, joined by line ends.

    A digest can only be taken from one end to the other, so a conversation's texts pass one task, a row at a time.
    """
    applied = _applied(turns)
    schema = StructType([turns.schema["conv_id"], *applied.schema.fields[5:], StructField("repaired_sha256", StringType())])
    kinds = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, ()

        for batch in batches:
            out = []
            for conv_id, place, role, text, *told in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text", *SUMMARY)], strict=True):
                if place is None:
                    if held:
                        out.append((*now, held.hexdigest()))
                    held, now = hashlib.sha256(), (conv_id, *told)
                else:
                    held.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*now, held.hexdigest()), kinds, strict=True)], schema=kinds)

    return applied.mapInArrow(digest, schema)
