import binascii
import hashlib
import itertools
import os
import random
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from leadq.llm import repair  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = binascii.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns) by keeping the whole least audit for each state, row after row; no divide and conquer."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def put(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def inserts(best):
        best = dict(best)
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                put(best, follow[state], (cost + 2, audit + "I", turns + ((name[follow[state]], ""),)))
        return best

    best = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, audit, turns) in inserts(best).items():
            put(new, state, (cost + 3, audit + "D", turns))
            if fault in ("", "truncated"):
                extra, initial = fault == "truncated", role[:1]
                if (initial == "s" and state == "") or (initial in ("u", "a") and follow[state] == initial):
                    put(new, initial, (cost + extra, audit + "K", turns + ((role, text),)))
                put(new, follow[state], (cost + extra + 2, audit + "R", turns + ((name[follow[state]], text),)))
        best = new
    ended = inserts(best)
    return min(ended[s] for s in ("", "a") if s in ended)


def report(rows, conv_ids):
    out = {}
    for conv in conv_ids:
        own = in_order([r for r in rows if r[0] == conv])
        numbers = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        kinds = faults(own)
        cost, audit, turns = cheapest(own)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("end", "ord", "node", "code", "fault", "first")})


@pytest.mark.parametrize("block_rows", [4, 4096])
def test_query_against_brute_force(spark, block_rows):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in repair.damage_report(df, block_rows).collect()}
    assert got == report(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", None, "User", "s", "us"]
    texts = ["Yes.", "no", "No!", "", " \t", None, "é?", "end.\n", "a", "b", "c?", "d!", "é" * 50_000 + "."]
    turns = [None, 0, 1, 1, 2, 3, 5, 8, 100, -2]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    rows += [(i, None, "user", "x") for i in range(10, 14)] + [(i, i, None, None) for i in range(20, 60)] + [(7, 1, "user", "same.")] * 40
    got = {r[0]: tuple(r)[1:] for r in repair.damage_report(frame(spark, rows).repartition(3), 8).collect()}
    assert got == report(damaged(rows), {r[0] for r in rows})


def test_every_short_sequence():
    """The divide and conquer against the row-by-row solution, for all sequences of codes up to a length."""
    texts = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "x": ("tool", ".")}
    for n in range(5):
        for codes in itertools.product("suaUA1x", repeat=n):
            rows = [(0, i, texts[c.lower()][0], f"{i}" + ("" if c.isupper() else ".")) if c != "1" else (0, i, "user", "") for i, c in enumerate(codes)]
            cost, audit, turns = cheapest(rows)
            letters, made = repair.edits("".join(codes) + ".", repair.START, repair.START)
            assert "".join(letters) == audit
            assert repair.forward([repair.moves(c) for c in [*codes, "."]], repair.START)[repair.START][0] == cost


def test_long_conversation_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(None, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["hm", "yes.", f"{i}."])) for i in range(3000)] + [(1, 0, "user", "hi.")]
    turns, told = repair.repair(frame(spark, rows), block_rows=4)
    got = {r.conv_id: r for r in told.collect()}
    want = report(rows, [None, 1])
    for conv, row in want.items():
        assert tuple(got[conv])[1:] == row[:-1]
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests(turns).collect()} == {c: w[-1] for c, w in want.items()}
    text = "\n".join(f"{r.role}:{r.text}" for r in sorted(turns.filter("conv_id is null").collect(), key=lambda r: (r.ord, r.step)))
    assert hashlib.sha256(text.encode()).hexdigest() == want[None][-1]


def test_empty_table_and_conversations_without_rows(spark):
    assert repair.damage_report(frame(spark, [])).count() == 0
    gone = next(i for i in range(1000) if binascii.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.damage_report(frame(spark, [(gone, 0, "user", "x.")])).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
