"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, first its code points.  A level turns the
sequence into phrases and names them; the names are the next level's symbols.
Runs of one symbol become one symbol first, so neighbours differ.  Then
deterministic coin tossing reduces every symbol to a small label: the place of
the lowest bit in which it differs from its left neighbour, and its value
there.  Three tosses leave labels under 8 that still differ from their
neighbours.  Phrases begin where a label is a local maximum.  All this looks at
a bounded neighbourhood only: equal substrings are cut and named alike, but for
a few symbols at their ends, at whatever offset they stand.

The fingerprint is a sketch of the names of all levels, the same for every
text: the least name in each of BINS parts.  Every level has parts of its own,
most of them the higher levels, whose phrases are long enough to tell texts
apart; so the many names of the low ones don't crowd them out.  The likeness of
two fingerprints estimates how far their names agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
DIGITS = 6
TOSSES = 3
#: Bins of level 1, level 2, and level 3 and up (phrases of about 27 characters
#: and more).  Long texts share most phrases of level 1, so these get few.
LEVEL_BINS = (2, 14, 48)
#: Stands for a null id, below all others.
LOWEST = -(1 << 63)
#: Ranges of ids that documents are sorted in; the driver holds an id of each.
MAX_RANGES = 10_000
#: Ids sampled for each range to place the cuts between ranges.
SAMPLED_IDS = 20
#: Code points parsed side by side.
BATCH_CHARS = 200_000

_EMPTY = (1 << 4 * DIGITS) - 1
_FIRST_BIN = (0, LEVEL_BINS[0], LEVEL_BINS[0] + LEVEL_BINS[1])
_ONE = np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Place of the lowest set bit of every 16-bit number; 0 of 0.
_LOWEST = np.zeros(1 << 16, dtype=np.uint8)
for _i in range(15, -1, -1):
    _LOWEST[1 << _i :: 2 << _i] = _i


def _lowest(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit of 64-bit numbers."""
    low = _LOWEST[x & np.uint64(0xFFFF)]
    rare = np.flatnonzero((x & np.uint64(0xFFFF)) == 0)
    if len(rare):
        far = x[rare]
        low[rare] = np.maximum(np.frexp((far & (~far + _ONE)).astype(np.float64))[1] - 1, 0)
    return low


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels under 8 of symbols that differ from their left neighbours; ``first`` are the places of the texts' first."""
    low = np.zeros(len(symbols), dtype=np.uint8)
    low[1:] = _lowest(symbols[1:] ^ symbols[:-1])
    low[first] = 0
    label = 2 * low + ((symbols >> low) & _ONE).astype(np.uint8)
    for _ in range(TOSSES - 1):
        low[1:] = _LOWEST[label[1:] ^ label[:-1]]
        low[first] = 0
        label = 2 * low + ((label >> low) & 1)
    return label


def _phrases(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names and texts of the phrases of ``symbols``, where ``text`` numbers the texts."""
    change = np.ones(len(symbols), dtype=bool)
    new = text[1:] != text[:-1]
    np.logical_or(symbols[1:] != symbols[:-1], new, out=change[1:])
    start = np.flatnonzero(change)
    if len(start) < len(symbols):
        run = np.diff(start, append=len(symbols))
        symbols, text = symbols[start], text[start]
        long = np.flatnonzero(run > 1)
        symbols[long] = _mix(symbols[long] + run[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        new = text[1:] != text[:-1]
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    label = _toss(symbols, first)
    begin = np.zeros(len(symbols), dtype=bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    # a maximum needs neighbours on both sides, and more than the text's first on the left
    begin[first - 1] = False
    begin[np.minimum(first + 1, len(begin) - 1)] = False
    begin[first] = True
    at = np.flatnonzero(begin)
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(at, append=len(symbols)))
    names = np.add.reduceat(_mix(symbols ^ _PLACES[np.minimum(place, len(_PLACES) - 1)]), at)
    return _mix(names), text[at]


#: Phrases are far shorter than this: labels under 8 without equal neighbours rise and fall soon.
_PLACES = np.arange(64, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def sketches(texts: list[str]) -> np.ndarray:
    """Fingerprints of the texts: an array (texts, BINS) of numbers."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points])
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    symbols = np.concatenate(points).astype(np.uint64) + _ONE if len(text) else np.zeros(0, np.uint64)
    out = np.full(len(texts) * BINS, _EMPTY, dtype=np.int64)
    none = np.flatnonzero(sizes == 0)
    _keep(out, np.zeros(len(none), np.uint64), none, 0)
    level = 0
    while len(symbols):
        symbols, text = _phrases(symbols, text)
        level += 1
        _keep(out, _mix(symbols + np.uint64(level)), text, level)
        done = (np.bincount(text, minlength=len(texts)) == 1)[text]
        symbols, text = symbols[~done], text[~done]
    return out.reshape(len(texts), BINS)


def _keep(out: np.ndarray, names: np.ndarray, owners: np.ndarray, level: int) -> None:
    """Lower the bins in ``out`` to the names of a level; an empty text's only name has level 0."""
    at = min(max(level, 1), len(LEVEL_BINS)) - 1
    names = _mix(names)
    slot = owners * np.int64(BINS) + _FIRST_BIN[at] + ((names >> np.uint64(48)) * np.uint64(LEVEL_BINS[at]) >> np.uint64(16)).astype(np.int64)
    np.minimum.at(out, slot, ((names >> np.uint64(8)) & np.uint64(_EMPTY)).astype(np.int64) % _EMPTY)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the share of the used bins that agree."""
    used = (a != _EMPTY) | (b != _EMPTY)
    return ((a == b) & used).sum(axis=1) / np.maximum(1, used.sum(axis=1))


def to_string(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - DIGITS // 2 :].tobytes().hex()


def _grouped(rows: Iterator[tuple], chars) -> Iterator[list[tuple]]:
    """Lists of rows of about BATCH_CHARS characters."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += chars(row)
        if n >= BATCH_CHARS:
            yield some
            some, n = [], 0
    if some:
        yield some


def fingerprint_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) per row; equal texts have equal fingerprints, a null text that of the empty one."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t.as_py()) for b in batches for i, t in zip(b.column(0), b.column(1)))
        for some in _grouped(rows, lambda r: len(r[1])):
            found = sketches([r[1] for r in some])
            yield pa.RecordBatch.from_arrays([pa.array([r[0].as_py() for r in some], pa.int64()), pa.array(map(to_string, found), pa.string())], [id, "fingerprint"])

    return docs.select(F.col(id).cast("long").alias(id), F.coalesce(text, F.lit(""))).mapInArrow(of, f"`{id}` long, fingerprint string")


def _edges(ids: DataFrame, ranges: int) -> np.ndarray:
    """Up to ``ranges`` ids of the table, sorted, that cut it into nearly even ranges; the last is its largest id.

    The cuts come from a seeded sample of about SAMPLED_IDS ids a range, whatever
    the table's size; where they lie decides the work's spread only.
    """
    row = ids.agg(F.count("*").alias("n"), F.max("id").alias("top")).first()
    if not row["n"]:
        return np.empty(0, np.int64)
    some = ids.sample(min(1.0, SAMPLED_IDS * ranges / row["n"]), 7).toArrow().column("id").to_numpy()
    cuts = np.sort(some)[np.arange(1, ranges) * len(some) // ranges] if len(some) else []
    return np.unique([*cuts, row["top"]]).astype(np.int64)


def neighbours(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, carry, id, none, text) in partitions sorted so that a document's next stands behind it.

    The order is by descending id.  Ranges of ids are the buckets; the largest id
    of a range is an id of the table, and its rows also stand, as ``carry``, at the end of
    the range above, and those of the last range at the end of the lowest one.
    """
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LOWEST)).alias("id"), F.col(id).isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = _edges(rows.select("id"), min(4 * parts, MAX_RANGES))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            bucket = np.searchsorted(edges, ids)  # edges below the id
            at_edge = np.flatnonzero(edges[bucket] == ids)
            above = np.where(ids[at_edge] == edges[-1], 0, bucket[at_edge] + 1)
            for chosen, to, carry in ((b, bucket, False), (b.take(pa.array(at_edge)), above, True)):
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.repeat(pa.scalar(carry), len(to)), *chosen.columns], ["bucket", "carry", "id", "none", "text"])

    spread = rows.mapInArrow(place, "bucket int, carry boolean, id long, none boolean, text string")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "carry", F.desc("id"), "text")


def edited(text: str, next_text: str) -> str:
    """``text`` with its last third replaced by the beginning of ``next_text``."""
    n = len(text) // 3
    return text[: len(text) - n] + next_text[:n]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(id, text, next text) of each row that isn't a carry."""
    last = None
    for b in batches:
        for bucket, carry, id, none, text in zip(*(b.column(i) for i in range(5))):
            bucket, carry, text = bucket.as_py(), carry.as_py(), text.as_py()
            if last and last[0] == bucket:
                yield last[1], last[2], text
            last = None if carry else (bucket, None if none.as_py() else id.as_py(), text)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they are.

    A null text counts as empty.  Documents with equal ids come by text; a null
    id comes last and stays null.  The only document of a table is its own next
    one, repeated rows are each other's, and an empty table gives an empty
    result.  Other columns don't matter.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _grouped(_pairs(batches), lambda r: 2 * len(r[1]) + len(r[2])):
            changed = [edited(t, n) for _, t, n in some]
            found = sketches([t for _, t, _ in some] + changed + [some[-1][2]])
            own, new = found[: len(some)], found[len(some) : -1]
            # the next document's fingerprint is the next row's own, but for the last row and at a bucket's end
            after = np.concatenate([own[1:], found[-1:]])
            lone = [i for i in range(len(some) - 1) if some[i][2] is not some[i + 1][1] and some[i][2] != some[i + 1][1]]
            if lone:
                after[lone] = sketches([some[i][2] for i in lone])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in some], pa.int64()), pa.array([len(r[1]) for r in some], pa.int64()),
                    pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
                    pa.array(map(to_string, own), pa.string()), pa.array(map(to_string, new), pa.string()),
                    pa.array(likeness(own, new)), pa.array(likeness(own, after)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return neighbours(docs).mapInArrow(of, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
