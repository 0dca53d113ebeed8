"""Conversation structure repair by Four-Russians block tables.

A conversation becomes a string over nine symbols: one for a turn that must go, and
for the others who speaks (system, user, assistant, else) and whether the turn is
cut off.  The cheapest edits that give ``(s?(ua)+)?`` are found over four states
(nothing yet, after a system, user or assistant turn).  Seen from the right, the
costs to go from the four states, less the least of them, take few different
vectors; for each vector and each block of ``BLOCK`` symbols a table has the vector
on the block's left and the cost between.  Blocks are looked up from right to left;
for the audit, going forward, each block is expanded backward from the vector on
its right, so that every edit can be chosen as the first in ASCII order that stays
cheapest.

A conversation of any length is split: turns without their texts are sorted by range,
each range cuts its conversations into chunks, and each chunk is reduced to its
symbols and to the map from vectors on its right to vectors on its left.  The maps are
chained from the last chunk to the first, then chunks and texts are streamed in
order, holding one chunk and a running SHA-256.  Only this last pass over a
conversation's texts is the work of one task, as a digest has to be.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Scratch

#: Fixed values of the contract: costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols of one block of the tables.
BLOCK = 4

# states: nothing yet, after a system, a user, an assistant turn
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # the state after the turn that may be inserted, or made by a new role
_ROLE = {_USER: b"user", _ASSISTANT: b"assistant"}
_END = (0, None, None, 0)  # the states that may end a conversation
SYMBOLS = 9  # 0: must go; else 1 + 2 * kind + truncated, kinds s, u, a and others


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a turn, in ASCII order of the letters."""
    out = [("D", DELETE, state)]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        if (kind == 0 and state == _START) or (kind == 1 and state != _USER) or (kind == 2 and state == _USER):
            out.append(("K", TRUNCATED * cut, (_SYSTEM, _USER, _ASSISTANT)[kind]))
        out.append(("R", REROLE + TRUNCATED * cut, _NEXT[state]))
    return out


def with_inserts(costs: list[int]) -> list[int]:
    """Costs to go where turns may be inserted first."""
    costs = list(costs)
    for _ in range(4):
        costs = [min(c, INSERT + costs[_NEXT[state]]) for state, c in enumerate(costs)]
    return costs


def before(symbol: int, costs: tuple[int, ...]) -> list[int]:
    """Costs to go in front of a turn, given those behind it."""
    return with_inserts([min(cost + costs[to] for _, cost, to in edits(symbol, state)) for state in range(4)])


@cache
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The vectors (the first is that of an ended conversation), and by vector and symbol, or by vector and
    block of symbols, the vector on the left and the cost taken out of it."""
    far = 10**6
    end = with_inserts([far if c is None else c for c in _END])
    vectors, number, steps = [tuple(end)], {tuple(end): 0}, []
    for v in vectors:  # grows as new vectors are met
        row = []
        for symbol in range(SYMBOLS):
            costs = before(symbol, v)
            least = min(costs)
            w = tuple(c - least for c in costs)
            if w not in number:
                number[w] = len(vectors)
                vectors.append(w)
            row.append((number[w], least))
        steps.append(row)
    to, cost = (np.array([[x[i] for x in row] for row in steps]) for i in range(2))
    block_to, block_cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), np.int64)
    for _ in range(BLOCK):  # one more symbol in front of all blocks so far
        block_to, block_cost = (
            np.concatenate([to[block_to, s] for s in range(SYMBOLS)], axis=1),
            np.concatenate([block_cost + cost[block_to, s] for s in range(SYMBOLS)], axis=1),
        )
    return vectors, to, cost, block_to, block_cost


_WEIGHTS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def _blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The string as its first few symbols and the codes of whole blocks behind them."""
    head = len(symbols) % BLOCK
    return symbols[:head], symbols[head:].reshape(-1, BLOCK).astype(np.int64) @ _WEIGHTS


def look_up(symbols: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of ``right``: the vector on the string's left, and the cost."""
    _, to, cost, block_to, block_cost = tables()
    head, codes = _blocks(symbols)
    total = np.zeros(len(right), np.int64)
    for code in codes[::-1]:
        total += block_cost[right, code]
        right = block_to[right, code]
    for symbol in head[::-1]:
        total += cost[right, symbol]
        right = to[right, symbol]
    return right, total


@cache
def choice(symbol: int, vector: int, state: int) -> tuple[str, int]:
    """The letters up to the turn's own edit, and the state behind it: of the cheapest, always the first in ASCII order."""
    behind = tables()[0][vector]
    here = before(symbol, behind)
    letters = ""
    while True:
        ways = [(letter, behind[to] + cost, to) for letter, cost, to in edits(symbol, state)]
        ways.append(("I", here[_NEXT[state]] + INSERT, _NEXT[state]))
        letter, state = min((letter, to) for letter, cost, to in ways if cost == here[state])
        letters += letter
        if letter != "I":
            return letters, state


def trace(symbols: np.ndarray, right: int, state: int) -> tuple[list[str], int]:
    """The letters of each turn of a string (inserts before it come first), and the state behind the string.

    ``right``: the vector behind the string, ``state``: the state in front of it."""
    _, to, _, block_to, _ = tables()
    head, codes = _blocks(symbols)
    behind = [right]  # the vector behind each block, from the last to the head
    for code in codes[::-1]:
        behind.append(int(block_to[behind[-1], code]))
    audit = []
    for block in [head, *symbols[len(head) :].reshape(-1, BLOCK)]:
        after = [behind.pop()]  # the block is expanded backward
        for symbol in block[:0:-1]:
            after.append(int(to[after[-1], symbol]))
        for symbol, vector in zip(block, reversed(after)):
            letters, state = choice(int(symbol), vector, state)
            audit.append(letters)
    return audit, state


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the contract's damage by the CRC of conv_id and turn; nulls count as one
    space (but for the order, where a null turn comes first).  copies is 0 for a dropped turn, 2 for a repeated one."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


#: Order of the turns of a conversation; rows of one turn by role and digest of the text.
ORDER = ("turn", "role", "digest")


def _kind(role: Column) -> Column:
    """By the role's first letter: s, u, a, any other."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in (("s", 0), ("u", 1), ("a", 2)) for x in pair]), F.substring(role, 1, 1)), F.lit(3))


def turns(damaged: DataFrame) -> DataFrame:
    """One row per conversation, turn, role and digest: ``n`` equal rows, their ``symbol`` (0: blank) and whether
    the first of them is the ``first`` of its role and text in the conversation.

    Equal rows are counted before they move, and a text's first turn is a least one, so
    neither a long conversation nor a text said very often meets in one task."""
    text = F.col("text")
    shown = F.regexp_replace(text, f"[{SPACE}]+\\z", "")
    symbol = F.when(F.length(shown) == 0, 0).otherwise(1 + 2 * _kind(F.col("role")) + F.when(F.substring(shown, -1, 1).isin(".", "!", "?"), 0).otherwise(1))
    light = damaged.filter("copies > 0").select("conv_id", "turn", "role", F.unhex(F.md5(text)).alias("digest"), symbol.cast("int").alias("symbol"), F.col("copies").cast("long").alias("n"))
    said = ["conv_id", "role", "digest"]
    seen = light.groupBy(*said).agg(F.min(F.struct("turn")).alias("at"), F.first("symbol").alias("symbol"))  # nulls first
    both = light.withColumn("first", F.lit(0)).unionByName(seen.select(*said, F.col("at.turn").alias("turn"), "symbol", F.lit(0).cast("long").alias("n"), F.lit(1).alias("first")))
    return both.groupBy("conv_id", *ORDER).agg(F.first("symbol").alias("symbol"), F.sum("n").alias("n"), F.max("first").alias("first"))


CHUNK = (
    "conv_id long, turn long, role string, digest binary, chunk int, symbols binary, lefts binary, costs array<long>, "
    "blank long, duplicate long, truncated long, illegal long, first_kind int, last_kind int, low long, high long, n_turns long"
)


class _Chunk:
    """What is gathered of a conversation's sorted turns within a task; rows come in pieces."""

    def __init__(self, conv_id, key):
        self.conv_id, self.key, self.symbols = conv_id, key, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_kind = self.last_kind = self.low = self.high = None

    def add(self, kind: np.ndarray, symbol: np.ndarray, n: np.ndarray, first: np.ndarray, turn: np.ndarray, no_turn: np.ndarray) -> None:
        blank = symbol == 0
        fresh = ~blank & (first == 1)
        self.blank += int(n[blank].sum())
        self.duplicate += int((n - first)[~blank].sum())
        self.truncated += int((fresh & (symbol % 2 == 0)).sum())
        start = np.cumsum(n) - n
        symbols = np.zeros(int(n.sum()), np.uint8)
        symbols[start[fresh]] = symbol[fresh]
        self.symbols.append(symbols.tobytes())
        pairs = zip(kind[:-1], kind[1:])
        if self.last_kind is not None:
            pairs = itertools.chain([(self.last_kind, kind[0])], pairs)
        self.illegal += int((n - 1).sum()) + sum(map(_illegal, pairs))
        self.first_kind = int(kind[0]) if self.first_kind is None else self.first_kind
        self.last_kind = int(kind[-1])
        if len(turn := turn[~no_turn]):
            self.n_turns += int((turn[1:] != turn[:-1]).sum()) + (self.high != turn[0])
            self.low = int(turn[0]) if self.low is None else self.low
            self.high = int(turn[-1])

    def row(self, chunk: int) -> tuple:
        symbols = b"".join(self.symbols)
        lefts, costs = look_up(np.frombuffer(symbols, np.uint8), np.arange(len(tables()[0])))
        return (
            self.conv_id, *self.key, chunk, symbols, lefts.astype(np.uint16).tobytes(), costs.tolist(), self.blank, self.duplicate,
            self.truncated, self.illegal, self.first_kind, self.last_kind, self.low, self.high, self.n_turns,
        )


def _illegal(pair) -> bool:
    return tuple(pair) not in ((0, 1), (1, 2), (2, 1))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns become one chunk per conversation and task."""
    chunk = TaskContext.get().partitionId()

    def rows():
        now = None
        for batch in batches:
            conv = batch["conv_id"]
            ids, no_id = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            turn, no_turn = batch["turn"].fill_null(0).to_numpy(zero_copy_only=False), batch["turn"].is_null().to_numpy(zero_copy_only=False)
            kind, symbol, n, first = (batch[c].to_numpy(zero_copy_only=False) for c in ("kind", "symbol", "n", "first"))
            edge = np.flatnonzero((ids[1:] != ids[:-1]) | (no_id[1:] != no_id[:-1])) + 1
            for start, end in zip([0, *edge], [*edge, len(ids)]):
                if end == start:
                    continue
                id_ = None if no_id[start] else int(ids[start])
                if now is None or now.conv_id != id_:
                    if now is not None:
                        yield now.row(chunk)
                    now = _Chunk(id_, [batch[c][start].as_py() for c in ORDER])
                at = slice(start, end)
                now.add(kind[at], symbol[at], n[at], first[at], turn[at], no_turn[at])
        if now is not None:
            yield now.row(chunk)

    yield from _batches(rows(), _schema(CHUNK))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from a conversation's last to its first: each gets the vector behind it, and the cost from it to the end."""
    conv = vector = None
    total = 0
    for batch in batches:
        rights, costs = [], []
        for id_, lefts, cost in zip(batch["conv_id"].to_pylist(), batch["lefts"].to_pylist(), batch["costs"]):
            if vector is None or id_ != conv:
                conv, vector, total = id_, 0, 0
            rights.append(vector)
            total += cost[vector].as_py()
            vector = int.from_bytes(lefts[2 * vector : 2 * vector + 2], "little")
            costs.append(total + tables()[0][vector][_START])
        kept = batch.drop_columns(["lefts", "costs"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rights, pa.int32()), pa.array(costs, pa.int64())], [*kept.schema.names, "right", "cost"])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repair:
    """A conversation as its chunks and texts pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.state, self.cost, self.letters = conv_id, [], _START, None, iter(())
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.last_kind = self.low = self.high = None
        self.digest, self.empty = hashlib.sha256(), True

    def chunk(self, c: dict) -> None:
        self.cost = c["cost"] if self.cost is None else self.cost  # that of the first chunk is from the start to the end
        letters, self.after = trace(np.frombuffer(c["symbols"], np.uint8), c["right"], self.state)
        self.audit += letters
        self.letters = iter(letters)
        for name in ("blank", "duplicate", "truncated", "illegal", "n_turns"):
            setattr(self, name, getattr(self, name) + c[name])
        if self.last_kind is not None:
            self.illegal += _illegal((self.last_kind, c["first_kind"]))
        self.last_kind = c["last_kind"]
        if c["low"] is not None:
            self.n_turns -= self.high == c["low"]
            self.low = c["low"] if self.low is None else self.low
            self.high = c["high"]

    def turn(self, role: bytes, text: bytes) -> None:
        if not self.empty:
            self.digest.update(b"\n")
        self.empty = False
        self.digest.update(role + b":")
        self.digest.update(text)

    def insert(self) -> None:
        self.state = _NEXT[self.state]
        self.turn(_ROLE[self.state], b"")

    def text(self, kind: int, role: str, text: str) -> None:
        *inserts, letter = next(self.letters)
        for _ in inserts:
            self.insert()
        if letter == "K":
            self.state = (_SYSTEM, _USER, _ASSISTANT)[kind]
            self.turn(role.encode(), text.encode())
        elif letter == "R":
            self.state = _NEXT[self.state]
            self.turn(_ROLE[self.state], text.encode())

    def row(self) -> tuple:
        while _END[self.state] is None:
            self.audit.append("I")
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.n_turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost or 0, "".join(self.audit), self.digest.hexdigest())


_FACTS = ("cost", "symbols", "right", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_kind", "last_kind", "low", "high")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks and texts become one row per conversation; each chunk stands in front of its turns."""

    def rows():
        now = None
        for batch in batches:
            facts = batch["chunk"]
            columns = zip(*(batch[c].to_pylist() for c in ("conv_id", "what", "kind", "role", "text", "copies")))
            for i, (id_, what, kind, role, text, copies) in enumerate(columns):
                if now is None or now.conv_id != id_:
                    if now is not None:
                        yield now.row()
                    now = _Repair(id_)
                if what == 0:
                    now.chunk(facts[i].as_py())
                for _ in range(copies):
                    now.text(kind, role, text)
        if now is not None:
            yield now.row()

    yield from _batches(rows(), _schema(RESULT))


def repair(damaged: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): its faults, cheapest repair and digest.

    Turns are in order of ``turn`` (nulls first), those of one turn by role and then
    by the digest of the text, ``copies`` times each; a row of no copies only names
    its conversation.  Role and text must not be null.  Rows with a null conv_id are
    one conversation.  No rows: no result.  Other columns are ignored.
    """
    scratch = Scratch(damaged.sparkSession, "repair")
    order = [F.asc_nulls_first(c) for c in ("conv_id", *ORDER)]
    light = scratch.stage(turns(damaged).withColumn("kind", _kind(F.col("role")).cast("int")), "turns")
    parts = int(damaged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = light.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    chunks = scratch.stage(cut.select("conv_id", *ORDER, "kind", "symbol", "n", "first").mapInArrow(_cut, CHUNK), "chunks")
    behind = ", ".join(x for x in CHUNK.split(", ") if not x.startswith(("lefts", "costs"))) + ", right int, cost long"
    chained = chunks.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.desc("chunk")).mapInArrow(_chained, behind)
    fronts = chained.select(
        "conv_id", *ORDER, F.lit(0).alias("what"), F.lit(0).alias("kind"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.struct(*_FACTS).alias("chunk"),
    )
    texts = damaged.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), F.lit(1).alias("what"), _kind(F.col("role")).cast("int").alias("kind"), "text", "copies")
    stream = fronts.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order, "what")
    return stream.mapInArrow(_repaired, RESULT)


def repair_report(conversations: DataFrame) -> DataFrame:
    """The conversations after the contract's damage, examined and repaired.

    Null roles and texts count as one space, so null and blank texts are blank turns;
    null turns come first and leave the gaps alone; all rows of a null conv_id are
    one conversation; equal rows and rows of one turn are ordered as in ``repair``.
    A conversation whose turns are all dropped has zeros, an empty audit and the
    digest of the empty text.  An empty table gives no rows."""
    return repair(damage(conversations))
