"""Conversation repair against a plain search for the cheapest edits and a plain fold of the damage."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidewire.llm import conversations, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def plain_search(rows):
    """rows: (initial, must go, truncated). Least (cost, letters) by a search in that order, with the roles it gives."""
    legal = lambda roles: re.fullmatch("(s?(ua)+)?", roles)
    prefix = lambda roles: re.fullmatch("|s|s?(ua)*u?", roles)
    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, letters, at, roles = heapq.heappop(todo)
        state = at, roles[-1:] if roles else ""
        if at == len(rows) and legal(roles):
            return cost, letters, roles
        if (state, letters) in done or cost > 3 * len(rows):
            continue
        done.add((state, letters))
        ways = [("I", 2, at, x) for x in "ua"]
        if at < len(rows):
            initial, gone, cut = rows[at]
            ways.append(("D", 3, at + 1, ""))
            if not gone:
                ways.append(("K", int(cut), at + 1, initial))
                ways += [("R", 2 + cut, at + 1, x) for x in "ua"]
        for letter, more, then, role in ways:
            if prefix(roles + role):
                heapq.heappush(todo, (cost + more, letters + letter, then, roles + role))


def code(initial, gone, cut):
    return "sua?".index(initial) + (4 if gone else 8 if cut else 0)


def test_edits_equal_a_search_over_all_short_conversations():
    kinds = [(i, g, c) for i in "sua?" for g, c in ((False, False), (True, False), (False, True))]
    for n in range(3):
        for rows in itertools.product(kinds, repeat=n):
            cost, letters, _ = plain_search(rows)
            assert conversations.cheapest_edits(bytes(code(*r) for r in rows)) == (cost, letters), rows


def test_edits_equal_a_search_over_random_conversations():
    r = random.Random(8)
    for _ in range(400):
        rows = [(r.choice("sua?uau"), r.random() < 0.15, False) for _ in range(r.randrange(3, 7))]
        rows = [(i, g, not g and r.random() < 0.3) for i, g, _ in rows]
        cost, letters, _ = plain_search(rows)
        assert conversations.cheapest_edits(bytes(code(*x) for x in rows)) == (cost, letters), rows


def plain(rows, damage=True):
    """The contract, row by row."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        own += [(turn, role, text)] * (2 if what == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, kinds, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            solid = SOLID.findall(text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "?", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        cost, audit, roles = plain_search(kinds)
        said, at, to = [], 0, iter(roles)
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role = next(to)
            text = "" if letter == "I" else own[at][2]
            name = own[at][1] if letter == "K" else {"u": "user", "a": "assistant"}[role]
            said.append((letter, name, text))
            at += letter != "I"
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in said).encode()).hexdigest()
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest), said
    return out


def mine(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_conversation_repair(spark, SF)
    assert out.columns == ["conv_id", *conversations.SUMMARY, "repaired_sha256"]
    assert mine(out) == {k: v for k, (v, _) in plain(rows).items()}
    assert out.count() == len({r[0] for r in rows})


def odd(seed, n):
    r = random.Random(seed)
    texts = [None, "", " \n", "Yes.", "no", "é 日本!", "wait? ", "a\x00.", "x　", "Yes.", ".", "\x1c"]
    roles = ["user", "assistant", "system", "User", "", None, "tool", "usher"]
    return [(r.choice([None, *range(n // 4)]), r.choice([None, 0, 1, 2, 3, 5, 9]), r.choice(roles[: r.choice([3, 8])]), r.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rows = [x for x in odd(seed, 160) if x[0] is not None] + [(None, None, None, None), (None, None, "user", "Hi."), (77, None, "user", "Hi."), (77, None, "user", "Hi.")]
    frame = spark.createDataFrame([(*x, 1, 2.5) for x in rows], TURNS + ", mark int, cost double")
    got = mine(conversations.repair_conversations(conversations.damaged(frame)))
    assert got == {k: v for k, (v, _) in plain(rows).items()}


def test_repaired_turns_without_damage(spark):
    rows = odd(7, 120)
    rows = [x for x in rows if x[0] is not None]
    want = plain(rows, damage=False)
    frame = spark.createDataFrame(rows, TURNS)
    got = {}
    for r in conversations.repaired_turns(frame).orderBy("conv_id", "place").collect():
        assert r.place == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.edit, r.role, r.text))
    assert got == {k: said for k, (_, said) in want.items() if said}
    assert mine(conversations.repairs(frame)) == {k: v[:-1] for k, (v, _) in want.items()}


def test_empty_tables_and_string_ids(spark):
    assert conversations.repair_conversations(conversations.damaged(spark.createDataFrame([], TURNS))).count() == 0
    frame = spark.createDataFrame([("a", 1, "user", "One."), ("a", 2, "assistant", "Two."), (None, 1, "user", "One.")], "conv_id string, turn int, role string, text string")
    assert {k: v[6] for k, v in mine(conversations.repair_conversations(frame)).items()} == {"a": "KK", None: "KI"}


def test_a_conversation_of_very_many_turns_and_a_very_long_text(spark):
    n = 200_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    hot = turns.unionByName(spark.createDataFrame([(2, 0, "user", "w " * 5_000_000 + "."), (2, 1, "user", "and?")], TURNS))
    got = mine(conversations.repair_conversations(hot))
    digest = hashlib.sha256("\n".join(f"{'assistant' if k % 2 else 'user'}:turn {k}." for k in range(n)).encode()).hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "K" * n, digest) and got[2][5:7] == (2, "KR")
