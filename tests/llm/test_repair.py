"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest_llm import SF, collected
from pyspark.sql import functions as F

from strikeflow.llm import repair as R
from strikeflow.llm.repair import damage, repair, repair_report

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """conv -> rows (turn, role, text) after damage; and all conversations."""
    out = {}
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        mine = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (2 if fate == 3 else 1)
    return out


def best(rows):
    """The cheapest edits (cost, audit, repaired) with whole audits and texts compared; rows are (role, text, must, cut)."""

    def add(cost, letter, line, rest):
        return (cost + rest[0], letter + rest[1], rest[2] if line is None else (line, *rest[2]))

    follows = {"-": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    table = {s: (0, "", ()) if s in "-a" else (10**9, "", ()) for s in "-sua"}

    def settle(t):
        for _ in range(5):
            t = {s: min(t[s], add(3, "I", full[follows[s]] + ":", t[follows[s]])) for s in t}
        return t

    table = settle(table)
    for role, text, must, cut in reversed(rows):
        new = {}
        for s in table:
            ways = [add(4, "D", None, table[s])]
            if not must:
                k = role[:1]
                if (k == follows[s] and k) or (k == "s" and s == "-"):
                    ways.append(add(3 * cut, "K", f"{role}:{text}", table[k]))
                ways.append(add(3 + 3 * cut, "R", f"{full[follows[s]]}:{text}", table[follows[s]]))
            new[s] = min(ways)
        table = settle(new)
    return table["-"]


def brute(rows):
    out = []
    for conv, mine in damaged(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            shown = BLANK.findall(text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in itertools.pairwise(marked))
        cost, audit, lines = best(marked)
        out.append((conv, gaps, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows, parts=4):
    clash = "text2 string, kind string, symbol int, digest string, chunk int, copies int, n int, first int, what int"
    return spark.createDataFrame([(*r, "x", "k", 1, "d", 2, 3, 4, 5, 6) for r in rows], "conv_id long, turn long, role string, text string, " + clash).repartition(parts)


def exhaustive(symbols):
    """Least cost, then least audit, of all edits, by search without tables."""
    found = {(0, R._START): (0, "")}
    heap = [(0, "", 0, R._START)]
    import heapq

    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if found.get((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(symbols) and R._END[state] is not None:
            return cost, audit
        ways = [("I", 3, R._NEXT[state], i)]
        if i < len(symbols):
            ways += [(a, c, to, i + 1) for a, c, to in R.edits(symbols[i], state)]
        for letter, c, to, j in ways:
            new = (cost + c, audit + letter)
            if new < found.get((j, to), (10**9, "")):
                found[(j, to)] = new
                heapq.heappush(heap, (*new, j, to))


def test_tables_against_search():
    rng = random.Random(5)
    for n in [*range(9)] * 60:
        symbols = np.array([rng.randrange(R.SYMBOLS) for _ in range(n)], np.uint8)
        (left,), (cost,) = R.look_up(symbols, np.zeros(1, np.int64))
        letters, state = R.trace(symbols, 0, R._START)
        audit = "".join(letters)
        while R._END[state] is None:
            audit, state = audit + "I", R._NEXT[state]
        assert (cost + R.tables()[0][left][R._START], audit) == exhaustive(list(symbols))


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert collected(repair_report(df), *COLUMNS) == brute(rows)


def odd_rows():
    rng = random.Random(6)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "umpire"]
    texts = ["a.", "a", "b!  \t", "", " \n", None, "c?x", "é.\x85", "?", "long " * 3000 + "."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in rng.choices([None, -3, 0, 1, 2, 3, 9], k=rng.randint(1, 9))]
    rows += [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(5)] + [(None, None, None, None)] * 3
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "gone.")] + rows[:40]


def test_odd_rows(spark):
    rows = odd_rows()
    want = brute(rows)
    assert collected(repair_report(frame(spark, rows)), *COLUMNS) == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in [r[1:] for r in want]


def test_empty(spark):
    assert collected(repair_report(frame(spark, [], 1)), *COLUMNS) == []


@pytest.mark.parametrize("parts", [1, 8])
def test_one_long_conversation(spark, parts):
    """Chunks of one conversation lie in many tasks; one text is said in every other turn."""
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(400)}{rng.choice('.x')}" if t % 2 else "ok.") for t in range(3000)]
    rows += [(2, t, "user", "one.") for t in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert collected(repair_report(frame(spark, rows, parts)), *COLUMNS) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_without_damage(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi.", 3), (1, 1, "assistant", "yes.", 1), (2, 0, "user", "x.", 0)], "conv_id long, turn long, role string, text string, copies int")
    got = {r[0]: r[1:] for r in collected(repair(df), *COLUMNS)}
    assert got[1][:7] == (0, 0, 2, 0, 2, 8, "KDDK") and got[2][6] == ""
    assert got[1][7] == hashlib.sha256(b"user:hi.\nassistant:yes.").hexdigest()


def test_damage_of_every_kind(spark):
    fates = {r.copies for r in damage(frame(spark, odd_rows())).select("copies").distinct().collect()}
    assert fates == {0, 1, 2}
    assert damage(frame(spark, odd_rows())).filter(F.col("text").isNull() | F.col("role").isNull()).count() == 0
