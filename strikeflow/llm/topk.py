"""Exact top-k search by integer inner product: distributed histogram selection.

Queries are rows of the same table and stand against all rows, in blocks of a
bounded number of queries.  A block's queries are broadcast (``BLOCK_BYTES`` at
most) and every row is scored against them where it lies; no row moves.  A pass
counts the scores of each query in ``BINS`` equal bins of an interval that holds
its k-th best score; the counts are summed over the tasks, the bin of the k-th
best is the next pass's interval, and when the bins are one wide the k-th best
score is known.  A last pass returns the scores above it and, of the ties, the
least ids; a window ranks these few.

A task leaves out of its counts, and of its ties, only what its own rows already
show to lie behind k better ones; so nothing is lost, however many rows tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

#: Intervals of one histogram, queries of one block at most, and their bytes at most.
BINS, BLOCK_ROWS, BLOCK_BYTES = 2048, 2048, 1 << 25
#: Rows scored at once by a task.
TILE = 512
#: Scores below this are exact as sums of doubles; beyond the next one they may not fit 64 bits.
EXACT, LARGEST = float(1 << 52), float(1 << 61)

RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, q (``floor(scale * x)`` of each component) and norm; vectors that are
    null or hold a null or non-finite component are left out."""
    x = F.col("embedding")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(math.inf)))
    q = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    kept = rows.filter(x.isNotNull() & ~odd).withColumn("_q", q)
    squares = F.aggregate("_q", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
    return kept.withColumns({"_norm": F.sqrt(squares)})


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A list column as rows of ``width`` numbers, filled up with zeros or cut: the other side has no more."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype)
    if len(lengths) and (lengths == lengths[0]).all():
        n = min(width, lengths[0])
        out[:, :n] = values.reshape(len(lengths), lengths[0])[:, :n]
        return out
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[place < width], place[place < width]] = values[place < width]
    return out


class Block:
    """The queries of one block and where their k-th best scores are known to lie."""

    def __init__(self, rows: pa.Table, k: int, longest_norm: float):
        rows = rows.combine_chunks()
        q = rows["q"].chunk(0) if rows["q"].num_chunks else pa.array([], pa.list_(pa.int64()))
        self.width = max(int(q.value_lengths().to_numpy(zero_copy_only=False).max(initial=0)), 1)
        bound = np.floor(rows["norm"].to_numpy() * longest_norm * (1 + 1e-9)) + 1
        if bound.max(initial=0) >= LARGEST:
            raise OverflowError(f"scores of {bound.max():.3g} do not fit 64 bits; take a smaller scale")
        dtype = np.float64 if bound.max(initial=0) < EXACT else np.int64
        self.q = np.ascontiguousarray(matrix(q, self.width, dtype).T)
        self.row = rows["row"].to_numpy()
        self.vec_id = rows["vec_id"]
        self.by_row = np.argsort(self.row)
        self.k = k
        self.low = -bound.astype(np.int64)
        self.step = -(-(2 * bound.astype(np.int64) + 1) // BINS)
        self.top = self.low + self.step * BINS
        self.need = np.full(len(self.row), k)
        self.settled = np.zeros(len(self.row), bool)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, scores of a tile of rows against all queries); a query's own row scores least."""
        row = batch["row"].to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(self.row[self.by_row], row), len(self.row) - 1)
        own = self.by_row[at]
        own = np.where(self.row[own] == row, own, -1)
        vectors = matrix(batch["q"], self.width, self.q.dtype)
        for start in range(0, len(row), TILE):
            score = (vectors[start : start + TILE] @ self.q).astype(np.int64)
            mine = np.flatnonzero(own[start : start + TILE] >= 0)
            score[mine, own[start : start + TILE][mine]] = np.iinfo(np.int64).min
            yield start, score


def _counted(block):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        counts = np.zeros((len(b.row), BINS), np.int64)
        least = b.low.copy()
        for batch in batches:
            for _, score in b.scores(batch):
                _, query = at = np.nonzero((score >= least) & (score < b.top))
                np.add.at(counts, (query, (score[at] - b.low[query]) // b.step[query]), 1)
            # bins behind this task's own need-th best can't hold the need-th best of all
            behind = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] >= b.need[:, None]
            least = b.low + b.step * (behind.sum(axis=1) - 1).clip(0)
        first = (least - b.low) // b.step
        query, bin_ = np.nonzero(counts)
        query, bin_ = query[bin_ >= first[query]], bin_[bin_ >= first[query]]
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(bin_.astype(np.int64)), pa.array(counts[query, bin_])], ["query", "bin", "n"])

    return count


def _best(query: np.ndarray, score: np.ndarray, id_: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: greatest score, then least id, no id last."""
    order = np.lexsort((id_, unnamed, -score, query))
    sorted_query = query[order]
    start = np.searchsorted(sorted_query, sorted_query)
    return order[np.arange(len(order)) - start < k]


def _found(block):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        for batch in batches:
            ids, unnamed = batch["vec_id"].fill_null(0).to_numpy(zero_copy_only=False), batch["vec_id"].is_null().to_numpy(zero_copy_only=False)
            for start, score in b.scores(batch):
                row, query = at = np.nonzero(score >= b.low)
                new = [query, score[at], ids[start + row], unnamed[start + row]]
                merged = [np.concatenate(pair) for pair in zip(best, new)]
                kept = _best(*merged, b.k)
                best = [column[kept] for column in merged]
        query, score, id_, no_id = best
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(id_, mask=no_id), pa.array(score)], ["query", "vec_id", "score"])

    return find


def _narrow(spark, block: Block, rows: DataFrame) -> None:
    """One pass: every query's interval becomes the bin that holds its k-th best score."""
    sent = spark.sparkContext.broadcast(block)
    counts = rows.select("row", "q").mapInArrow(_counted(sent), "query long, bin long, n long")
    needs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(block.need)], "query long, need long")
    # one row per query of the block: its size is bounded by BLOCK_ROWS
    sums = counts.groupBy("query", "bin").agg(F.sum("n").alias("n")).join(F.broadcast(needs), "query")
    down = Window.partitionBy("query").orderBy(F.desc("bin"))
    reached = sums.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") >= F.col("need"))
    chosen = reached.groupBy("query").agg(F.max("bin").alias("bin"), F.min(F.col("upto") - F.col("n")).alias("above")).collect()
    sent.unpersist()
    low, top, need, step = block.low - 1, block.low - 1, block.need.copy(), np.ones_like(block.step)  # fewer rows than k: all of them
    settled = np.ones(len(block.row), bool)
    for c in chosen:
        i, width = c["query"], block.step[c["query"]]
        low[i] = block.low[i] + c["bin"] * width
        top[i] = min(low[i] + width, block.top[i])
        need[i] -= c["above"]
        step[i] = -(-width // BINS)
        settled[i] = width == 1
    block.low, block.top, block.need, block.step, block.settled = low, top, need, step, settled


def top_k(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's ``k`` rows of greatest score.

    ``rows`` has ``vec_id`` and ``embedding`` (an array of numbers); other columns
    are ignored.  Components become ``floor(scale * x)``, the score is their inner
    product, ties go to the smaller vec_id.  ``is_query`` marks the query rows; a
    query's candidates are all rows but itself, also those of its own vec_id.

    Vectors that are null or hold a null or non-finite component take no part.  A
    shorter vector counts as filled up with zeros (an empty one scores 0).  A row
    without vec_id can be found (last among ties) and counts as a query only where
    ``is_query`` is true of it.  Repeated rows are rows of their own, as queries
    too.  Without queries or other rows the result is empty.  OverflowError where
    scores may not fit 64 bits.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    q = quantised(rows, scale).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("_q").alias("q"),
        F.col("_norm").alias("norm"), F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    q = scratch.stage(q, "vectors")  # written: the numbers of the rows are fixed from here on
    about = q.agg(F.max("norm").alias("norm"), F.max(F.size("q")).alias("width"), F.count_if("asks").alias("asking")).first()
    if not about["asking"]:
        return spark.createDataFrame([], RESULT)
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(about["width"], 1))))
    blocks = -(-about["asking"] // size)
    asking = q.filter("asks").select("row", "vec_id", "q", "norm").repartition(blocks).withColumn("block", F.spark_partition_id())
    path = f"{scratch.root}/queries"
    asking.write.partitionBy("block").parquet(path)
    asking = spark.read.schema("row long, vec_id long, q array<long>, norm double, block int").parquet(path)

    found = f"{scratch.root}/found"
    for b in range(blocks):
        mine = asking.filter(F.col("block") == b).drop("block")
        block = Block(mine.toArrow(), k, about["norm"])
        if not len(block.row):
            continue
        while not block.settled.all():
            _narrow(spark, block, q)
        sent = spark.sparkContext.broadcast(block)
        near = q.select("row", "vec_id", "q").mapInArrow(_found(sent), "query long, vec_id long, score long")
        names = spark.createDataFrame(pa.table({"query": np.arange(len(block.row)), "query_id": block.vec_id}))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        best = near.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(names), "query")
        best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(found)
        sent.unpersist()
    return spark.read.schema(RESULT).parquet(found)


def top_k_report(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The top ``k`` of the rows whose vec_id is divisible by ``every``; odd input as in ``top_k``."""
    return top_k(vectors, F.col("vec_id") % every == 0, k)
