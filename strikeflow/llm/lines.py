"""Line dedup over levelled sorted runs of line hashes.

The corpus comes in batches.  A batch's distinct lines are hashed, counted and
merge-anti-joined with the runs: lines that a run has settled (found in
``min_docs`` documents) are removed, and the rest becomes a new run of level 0,
one row per hash with the number of documents of this batch that have it.  A
hash whose number over all runs reaches ``min_docs`` here is settled by this
row and never enters again.  When a level holds ``fan_out`` runs, they are
merged into one run of the next level.  At the end documents lose the lines
whose hash is settled.

A run is a table bucketed and sorted by hash, one file a bucket, so both kinds
of merge read the runs in order, bucket by bucket, and shuffle none of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, keeps_columns, let, quiet_conf

MIN_DOCS = 10
BATCHES = 4
FAN_OUT = 2
#: Settled hashes up to this number (16 bytes each) are broadcast to the
#: documents; more are joined by shuffle.
BROADCAST_HASHES = 250_000

_WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_keys(text: str | None) -> list[bytes]:
    """Key of each line: without ASCII white space at both ends, A-Z in lower case; null text: one empty line."""
    return [x.strip(_WHITE) for x in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")]


def line_hashes(docs: DataFrame, batches: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line that isn't blank: batch, id, t (hash of the text), at, first (in its document), a, b (128 bits of the key)."""

    def of(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            owner, at, first, digest = [], [], [], []
            for i, line in enumerate(r.column(3)):
                seen = set()
                for k, key in enumerate(line_keys(line.as_py())):
                    if key:
                        owner.append(i)
                        at.append(k)
                        first.append(key not in seen)
                        digest.append(xxhash.xxh3_128_digest(key))
                        seen.add(key)
            pairs = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            owner = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(r.column(i).take(owner) for i in range(3)), pa.array(at, pa.int32()), pa.array(first, pa.bool_()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                ["batch", "id", "t", "at", "first", "a", "b"],
            )

    batch = F.pmod(F.xxhash64(F.col(id)), F.lit(batches)).cast("int")
    rows = docs.select(batch.alias("batch"), F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "batch int, id long, t long, at int, first boolean, a long, b long")


class LineRuns:
    """The runs of one corpus, in a folder under the shared one.

    A hash counts once per document and batch: give every document to one batch.
    The number of buckets is the session's ``spark.sql.shuffle.partitions`` at
    the first batch.
    """

    def __init__(self, spark, min_docs: int = MIN_DOCS, fan_out: int = FAN_OUT):
        if min_docs < 1 or fan_out < 2:
            raise ValueError("min_docs is at least 1 and fan_out at least 2")
        self.spark, self.scratch = spark, Scratch(spark, "lines")
        self.min_docs, self.fan_out = min_docs, fan_out
        self.levels: dict[int, list[tuple[str, DataFrame]]] = defaultdict(list)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._made = 0

    def _write(self, df: DataFrame) -> tuple[str, DataFrame]:
        """Write a run: a bucketed table under the scratch folder, whose files stay when the catalog forgets it."""
        self._made += 1
        name = f"run-{self._made}"
        entry = f"{self.scratch.root.rsplit('/', 1)[1]}_{self._made}".replace("-", "_")
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.root}/{name}")
        # a bucket that is one file is read in its order
        with quiet_conf(self.spark, spark__sql__legacy__bucketedTableScan__outputOrdering="true"):
            writer.bucketBy(self.buckets, "a", "b").sortBy("a", "b").saveAsTable(entry)
        run = self.spark.table(entry).hint("merge")
        self.spark.sql(f"DROP TABLE {entry}")
        return name, run

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels.values() for _, run in level]

    def add(self, hashes: DataFrame) -> None:
        """Add a batch: a row (a, b) for each document and distinct line of it."""
        self.levels[0].append(self._write(self._fresh(hashes)))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            self._compact(level)
            level += 1

    def _fresh(self, hashes: DataFrame) -> DataFrame:
        """The batch's own run: what no earlier run has settled, with its number of documents, or the whole number
        where that reaches the threshold now."""
        run = hashes.groupBy("a", "b").agg(F.count("*").alias("docs"))
        before = []
        for i, old in enumerate(self.runs()):
            run = run.join(old.withColumnRenamed("docs", f"docs_{i}"), ["a", "b"], "left")
            before.append(F.coalesce(f"docs_{i}", F.lit(0)))
        if not before:
            return run
        unsettled = reduce(Column.__and__, [n < self.min_docs for n in before])
        total = reduce(Column.__add__, before, F.col("docs"))
        return run.where(unsettled).select("a", "b", F.when(total >= self.min_docs, total).otherwise(F.col("docs")).alias("docs"))

    def _compact(self, level: int) -> None:
        """Merge the runs of a level, two at a time, into one of the next level."""
        first, *others = self.levels.pop(level)
        for other in others:
            merged = self._write(self._merged(first[1], other[1]))
            for old, _ in (first, other):
                self.scratch.drop(old)
            first = merged
        self.levels[level + 1].append(first)

    @staticmethod
    def _merged(x: DataFrame, y: DataFrame) -> DataFrame:
        """Both runs in one.  A settled hash stays settled: the sum is no less than the number that settled it."""
        both = x.withColumnRenamed("docs", "docs_x").join(y.withColumnRenamed("docs", "docs_y"), ["a", "b"], "full")
        return both.select("a", "b", (F.coalesce("docs_x", F.lit(0)) + F.coalesce("docs_y", F.lit(0))).alias("docs"))

    def settled(self) -> DataFrame:
        """Every hash (a, b) found in at least ``min_docs`` documents of the batches so far, once."""
        found = [run.where(F.col("docs") >= self.min_docs).select("a", "b") for run in self.runs()]
        return reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], "a long, b long"))

    def finish(self) -> DataFrame:
        """The settled hashes, in a table of their own; the runs are removed."""
        found = self.scratch.stage(self.settled(), "settled")
        for level in self.levels.values():
            for name, _ in level:
                self.scratch.drop(name)
        self.levels.clear()
        return found


def frequent_places(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fan_out: int = FAN_OUT, id: str = "doc_id", text: str = "text", broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(id, t, found): per document with such lines, the places of those found in at least ``min_docs`` documents.

    Few frequent hashes reach the documents' line hashes by broadcast, many by
    a shuffle.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fan_out)
    path = f"{runs.scratch.root}/hashes"
    rows = line_hashes(docs, batches, id, text)
    rows.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    hashes = spark.read.schema(rows.schema).parquet(path)
    for batch in range(batches):
        runs.add(hashes.where((F.col("batch") == batch) & F.col("first")).select("a", "b"))
    frequent = runs.finish()
    few = frequent.count() <= broadcast_hashes
    places = hashes.select("id", "t", "at", "a", "b").join(F.broadcast(frequent) if few else frequent, ["a", "b"])
    return places.groupBy("id", "t").agg(F.collect_set("at").alias("found"))


def split_lines(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_n`` lines and ``_kept``, the text without the lines at the places ``found``."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_found")), lambda i: F.get(x, i)), "\n"))
    found = found.withColumnsRenamed({"id": "_id", "t": "_t", "found": "_found"})
    joined = docs.withColumn("_h", F.xxhash64(F.col(text))).join(found, F.col(id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_t")), "left")
    return joined.withColumn("_n", F.size(lines)).withColumn("_kept", F.when(F.col("_found").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(left))


@keeps_columns
def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines found in at least ``min_docs`` documents; columns as given.

    Lines are compared by ``line_keys``; blank lines always stay.  A null or
    empty text is one empty line and comes back empty.  Rows with the same id
    and text count as documents of their own.  A text that loses all lines
    comes back empty, an empty table stays empty, other columns pass through,
    whatever their names.
    """
    split = split_lines(docs, frequent_places(docs, min_docs, batches, id=id, text=text), id, text)
    return split.withColumn(text, F.col("_kept")).select(*docs.columns)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: lines before, lines dropped, SHA-256 of what stays."""
    docs = docs.select("doc_id", "text")
    return split_lines(docs, frequent_places(docs)).select(
        "doc_id",
        F.col("_n").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.array_distinct("_found")), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )
