"""Substring dedup by De Bruijn compaction over word windows.

The edges of the graph are windows of 50 words.  Consecutive windows of a
document whose least inner 16-word k-mer is the same one form a *stretch*, a
path without branches as far as that document can tell; it is one row, not one
row per window.  K-mers found in one document only are dropped.  Stretches
with the same words then compact by joins into one path with its smallest
source document: every later document loses the whole stretch.  Where
different paths run through the same k-mer, the graph branches, and the
windows of the paths' first sources are compared one by one.  A document's
removed windows come back as source coordinates (document, start, end), which
merge into spans over its words.

Words are compared through hashes of the words at those coordinates: a stretch
by 128 bits (its k-mer and the whole of it), a window by 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, keeps_columns

WINDOW = 50
KMER = 16
#: Distinct words whose hashes a task keeps at a time.
WORDS_KEPT = 1 << 18

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """Number of each word seen; its two hashes are in ``pairs``."""

    def __init__(self):
        super().__init__()
        self.pairs = bytearray()

    def __missing__(self, word: bytes) -> int:
        self.pairs += xxhash.xxh3_128_digest(word)
        self[word] = n = len(self)
        return n

    def of(self, w: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
            self.pairs = bytearray()
        at = np.fromiter(map(self.__getitem__, w), dtype=np.int64, count=len(w))
        return np.frombuffer(bytes(self.pairs), dtype=np.uint64).reshape(-1, 2)[at]


@cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base = np.full(n, _BASES[which], dtype=np.uint64)
    inverse = np.full(n, pow(_BASES[which], -1, 1 << 64), dtype=np.uint64)
    base[:1] = inverse[:1] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


class _Spans:
    """Hashes of any spans of a document's words, each in constant time."""

    def __init__(self, hashes: np.ndarray):
        n = 1 << (len(hashes) + 1).bit_length()
        self.inverse, self.sums = [], []
        for i in range(2):
            power, inverse = _powers(i, n)
            self.inverse.append(inverse)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, i] * power[: len(hashes)], dtype=np.uint64)]))

    def hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[which][end] - self.sums[which][start]) * self.inverse[which][start] + (end - start).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)  # spread the bits, one to one
        return h ^ (h >> np.uint64(29))


def split(text: str | None) -> list[bytes]:
    """The words of a text; bytes split at ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def stretches(spans: _Spans, n: int, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hash, stretch hash, first window, last window) of each stretch among ``n`` words."""
    at = np.arange(n - kmer + 1)
    order = spans.hash(1, at, at + kmer)
    least = np.lib.stride_tricks.sliding_window_view(order, window - kmer + 1).argmin(axis=1)
    least += np.arange(len(least))
    first = np.flatnonzero(np.diff(least, prepend=-1))
    last = np.append(first[1:], len(least)) - 1
    return order[least[first]], spans.hash(0, first, last + window), first, last


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.hash(F.col(text)).alias("t"), F.col(text).alias("text"))


def _stretch_table(docs: DataFrame, window: int, kmer: int) -> DataFrame:
    """(k, p, id, t, first, last) of every stretch of ``docs`` (id, t, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for b in batches:
            for id, t, text in zip(*(b.column(i) for i in range(3))):
                w = split(text.as_py())
                if id.as_py() is None or len(w) < window:
                    continue
                found = stretches(_Spans(words.of(w)), len(w), window, kmer)
                n = len(found[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64)),
                        pa.repeat(id, n), pa.repeat(t, n),
                        pa.array(found[2].astype(np.int32)), pa.array(found[3].astype(np.int32)),
                    ],
                    ["k", "p", "id", "t", "first", "last"],
                )

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for b in of(batches):
            some.append(b)
            n += len(b)
            if n > 50_000:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, n = [], 0
        if some:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    return docs.mapInArrow(gathered, "k long, p long, id long, t int, first int, last int")


def _window_table(opened: DataFrame, window: int) -> DataFrame:
    """(a, b, id, t, at) of the windows listed in ``opened`` (id, t, text, runs: array of (first, last))."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for b in batches:
            for id, t, text, runs in zip(*(b.column(i) for i in range(4))):
                w = split(text.as_py())
                spans = _Spans(words.of(w))
                at = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs.as_py()]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(spans.hash(0, at, at + window).view(np.int64)), pa.array(spans.hash(1, at, at + window).view(np.int64)),
                        pa.repeat(id, len(at)), pa.repeat(t, len(at)), pa.array(at.astype(np.int32)),
                    ],
                    ["a", "b", "id", "t", "at"],
                )

    return opened.mapInArrow(of, "a long, b long, id long, t int, at int")


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, kmer: int = KMER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, spans): word ranges (first, end) of windows that also start in a document with a smaller id."""
    rows = _rows(docs, id, text)
    edges = scratch.stage(_stretch_table(rows, window, kmer), "edges")
    # the right sides below are written first, so that both sides of each join are plain shuffles, whose hot keys Spark can split
    shared = edges.groupBy(F.col("k").alias("k2")).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("k2")
    shared = scratch.stage(shared, "kmers")
    edges = scratch.stage(edges.join(shared, F.col("k") == F.col("k2"), "left_semi"), "shared")
    scratch.drop("edges")
    paths = scratch.stage(edges.groupBy(F.col("k").alias("k2"), F.col("p").alias("p2")).agg(F.min("id").alias("source")), "paths")
    branched = scratch.stage(paths.groupBy(F.col("k2").alias("k3")).agg(F.count("*").alias("n")).where("n > 1").select("k3"), "branched")
    placed = scratch.stage(edges.join(paths, (F.col("k") == F.col("k2")) & (F.col("p") == F.col("p2"))).select("k", "id", "t", "first", "last", "source"), "placed")
    later = placed.where("id > source").select("id", "t", "first", (F.col("last") + window).alias("end"))

    runs = (
        placed.where("id = source")
        .join(branched, F.col("k") == F.col("k3"), "left_semi")
        .groupBy(F.col("id").alias("id2"), F.col("t").alias("t2"))
        .agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    )
    opened = rows.join(runs, (F.col("id") == F.col("id2")) & (F.col("t") == F.col("t2"))).select("id", "t", "text", "runs")
    windows = scratch.stage(_window_table(opened, window), "windows")
    first = windows.groupBy(F.col("a").alias("a2"), F.col("b").alias("b2")).agg(F.min("id").alias("source"), F.max("id").alias("high")).where("source < high").drop("high")
    first = scratch.stage(first, "sources")
    branches = (
        windows.join(first, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
        .where("id > source")
        .select("id", "t", F.col("at").alias("first"), (F.col("at") + window).alias("end"))
    )
    return later.unionByName(branches).groupBy("id", "t").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def _cut(w: list[bytes], spans: list[dict] | None) -> list[bytes]:
    """The words outside the spans."""
    if not spans:
        return w
    cover = np.zeros(len(w) + 1, dtype=np.int32)
    np.add.at(cover, [s["first"] for s in spans], 1)
    np.add.at(cover, [s["end"] for s in spans], -1)
    return [w[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def _joined(docs: DataFrame, window: int, kmer: int, id: str, text: str) -> DataFrame:
    spans = repeated_spans(docs, Scratch(docs.sparkSession, "substrings"), window, kmer, id, text)
    spans = spans.withColumnsRenamed({"id": "_id", "t": "_t", "spans": "_spans"})
    hashed = docs.withColumn("_h", F.hash(F.col(text)))
    return hashed.join(spans, (F.col(id).cast("long") == F.col("_id")) & (F.col("_h") == F.col("_t")), "left").drop("_id", "_t", "_h")


@keeps_columns
def substring_dedup(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated windows of ``window`` words; a changed text is its words joined by spaces.

    A word goes if a window over it also starts in a document with a smaller
    id, judged on the input.  Texts without such words, also null and empty
    ones, stay as they are.  Rows of the same id are never each other's source,
    so repeated rows are treated alike; a null id neither gives nor loses
    words.  An empty table stays empty; other columns pass through,
    whatever their names.
    """
    joined = _joined(docs, window, kmer, id, text)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return texts.combine(spans, lambda t, s: b" ".join(_cut(split(t), None if s is None else list(s))).decode("utf-8", "surrogatepass"))

    changed = joined.withColumn("_cut", F.when(F.col("_spans").isNotNull(), cut(F.col(text), F.col("_spans"))))
    return changed.withColumn(text, F.coalesce("_cut", F.col(text))).select(*docs.columns)


def substring_report(docs: DataFrame) -> DataFrame:
    """Per document: words, words removed, SHA-256 of the words that stay."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2)):
                w = split(text.as_py())
                kept = _cut(w, spans.as_py())
                out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _joined(docs.select("doc_id", "text"), WINDOW, KMER, "doc_id", "text")
    return joined.select("doc_id", "text", "_spans").mapInArrow(of, "doc_id long, n_words long, n_removed long, kept_sha256 string")
