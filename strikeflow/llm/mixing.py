"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r, the number of times the mix takes it.  Among all
rates between 0 and ``max_repeats`` that give each source its target of words,
the one nearest to r = 1 in relative entropy is exponentially tilted in the
document's size: r = min(max_repeats, exp(lambda * size / mean size)), with one
lambda per source.  The lambdas solve a convex dual; Newton's method finds
them, each step being one Spark aggregate over the size histogram
(source, size, documents), which holds all that the dual needs of the corpus.

Rates become whole copies by systematic rounding in size order, so the words
taken miss the target by one document at most, and a few corrections by single
copies bring them nearer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, keeps_columns, words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
NEWTON_STEPS = 40
TOLERANCE = 1e-6
CORRECTIONS = 4
#: Documents of equal source and size are ranked in so many parts.
RANK_PARTS = 256


def water_fill(sizes: dict, weights: dict, total: float, cap: float = MAX_REPEATS) -> dict:
    """Targets in proportion to the weights, none above ``cap`` times its source's size.

    What a source can't take is shared by weight among the rest, until none is above.
    """
    target, open_, left = {}, [s for s in sizes if sizes[s] > 0], float(total)
    target = {s: 0.0 for s in sizes}
    while open_:
        weight = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / weight > cap * sizes[s]]
        if not full:
            return target | {s: left * weights[s] / weight for s in open_}
        for s in full:
            target[s] = cap * float(sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def cycle_weights(sources: Sequence[str | None], weights: Sequence[float] = WEIGHTS) -> dict:
    """Weights dealt in turn to the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(weights[i % len(weights)]) for i, s in enumerate(ordered)}


def _lookup(spark, values: dict, name: str) -> DataFrame:
    """A table of one row per source: the size of the mixing configuration."""
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], f"_s string, {name} double")


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), lam * size / mean)))


def solve_rates(hist: DataFrame, sizes: dict, docs: dict, targets: dict, cap: float = MAX_REPEATS, steps: int = NEWTON_STEPS, tolerance: float = TOLERANCE) -> dict:
    """Lambda per source; None where every rate is ``cap``, the target 0 or the source without words.

    ``hist`` has rows (source, size, n).  The words taken rise with lambda, so
    each source keeps a bracket and halves it where a Newton step leaves it.
    Raises ArithmeticError if a source is still off its target after ``steps``.
    """
    spark = hist.sparkSession
    todo = {s: [0.0, -math.inf, math.inf] for s in sizes if sizes[s] > 0 and 0 < targets[s] < cap * sizes[s] * (1 - 1e-9)}
    done = {s: None for s in sizes if s not in todo}
    for _ in range(steps):
        if not todo:
            break
        at = spark.createDataFrame([(s, v[0], sizes[s] / docs[s]) for s, v in todo.items()], "_s string, lam double, mean double")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        taken = F.col("n") * F.col("size") * rate
        sums = (
            hist.join(F.broadcast(at), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source")
            .agg(F.sum(taken).alias("taken"), F.sum(F.when(rate < cap, taken * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
            .collect()  # one row per source
        )
        for row in sums:
            s, (lam, low, high) = row["source"], todo[row["source"]]
            miss = row["taken"] - targets[s]
            if abs(miss) <= tolerance * targets[s]:
                done[s] = lam
                del todo[s]
                continue
            low, high = (lam, high) if miss < 0 else (low, lam)
            new = lam - miss / row["slope"] if row["slope"] > 0 else math.nan
            if not low < new < high:
                new = (low + high) / 2 if math.isfinite(low + high) else lam + (1.0 if miss < 0 else -1.0) * max(1.0, abs(lam))
            todo[s] = [new, low, high]
    if todo:
        raise ArithmeticError(f"{steps} Newton steps leave {len(todo)} sources off their targets, {next(iter(todo))!r} among them")
    return done


def _whole_copies(hist: DataFrame, cap: int, corrections: int) -> DataFrame:
    """``hist`` (source, size, n, rate, target) with ``copies``: all copies of the n documents together."""
    in_order = Window.partitionBy("source").orderBy("size")
    whole = Window.partitionBy("source")
    hist = hist.withColumn("_sum", F.sum(F.col("n") * F.col("rate")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    hist = hist.withColumn("copies", (F.floor(F.col("_sum") + 0.5) - F.coalesce(F.lag(F.floor(F.col("_sum") + 0.5)).over(in_order), F.lit(0))).cast("long"))
    hist = hist.withColumn("copies", F.least(F.col("copies"), F.col("n") * cap))
    for _ in range(corrections):
        # one document of each source more or fewer, where that comes nearer to the target
        miss = F.sum(F.col("copies") * F.col("size")).over(whole) - F.col("target")
        hist = hist.withColumn("_miss", miss)
        can = F.when(F.col("_miss") > 0, F.col("copies") > 0).otherwise(F.col("copies") < F.col("n") * cap)
        left = F.when(can & (F.col("size") > 0), F.abs(F.abs(F.col("_miss")) - F.col("size")))
        hist = hist.withColumn("_best", F.min_by(F.struct("size"), F.struct(left.isNull(), left, "size")).over(whole)["size"])
        better = can & (F.col("size") == F.col("_best")) & (left < F.abs(F.col("_miss")))
        hist = hist.withColumn("copies", F.col("copies") - F.when(better, F.signum("_miss")).otherwise(0).cast("long"))
    return hist.drop("_sum", "_miss", "_best")


def mix(docs: DataFrame, weights: dict | None = None, total: float | None = None, cap: int = MAX_REPEATS, id: str = "doc_id", text: str = "text", source: str = "source", order: str | None = None, corrections: int = CORRECTIONS) -> DataFrame:
    """Per row of ``docs``: ``id``, size, source_size, target, rate, copies.

    ``order``: the column, by default ``id``, whose hash decides which of the
    rows of equal source and size get a copy more.  ``weights``: by source, null included; by default 5, 2, 1 in turn by code
    point.  ``total``: words of the mix, by default all there are.  Size counts
    the words of the text; a null or blank text has size 0, rate and copies 0.
    A null source is a source of its own.  Rows of equal source and size are
    told apart by that hash, then by id.  An empty table gives an empty result;
    other columns don't matter.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.stage(docs.select(F.col(id).alias("id"), F.xxhash64(F.col(order or id)).alias("_h"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text))).cast("long").alias("size")), "sized")
    hist = scratch.stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "hist")
    per = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n")).collect()  # one row per source
    sizes, counts = {r["source"]: r["size"] for r in per}, {r["source"]: r["n"] for r in per}
    weights = cycle_weights(list(sizes)) if weights is None else weights
    targets = water_fill(sizes, weights, sum(sizes.values()) if total is None else total, cap)
    lams = solve_rates(hist, sizes, counts, targets, cap)

    plan = spark.createDataFrame(
        [(s, lams[s], sizes[s] / counts[s], float(targets[s]), int(sizes[s])) for s in sizes],
        "_s string, lam double, mean double, target double, source_size long",
    )
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), F.when(F.col("target") > 0, float(cap)).otherwise(0.0)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
    hist = hist.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
    hist = scratch.stage(_whole_copies(hist, cap, corrections).select("source", "size", "n", "rate", "copies", "target", "source_size"), "copies")

    # rank the documents of equal source and size in hash order: within small parts, then the parts' offsets
    ranked = sized.withColumn("_part", F.pmod(F.col("_h"), F.lit(RANK_PARTS)))
    parts = ranked.groupBy("source", "size", "_part").agg(F.count("*").alias("_n"))
    offsets = parts.withColumn("_offset", F.sum("_n").over(Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    offsets = offsets.join(hist.withColumnsRenamed({"source": "_s2", "size": "_z2"}), F.col("source").eqNullSafe(F.col("_s2")) & (F.col("size") == F.col("_z2"))).drop("_n", "_s2", "_z2")
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "_part").orderBy("_h", "id")) - 1)
    offsets = offsets.withColumnsRenamed({"source": "_s3", "size": "_z3", "_part": "_p3"})
    joined = ranked.join(offsets, F.col("source").eqNullSafe(F.col("_s3")) & (F.col("size") == F.col("_z3")) & (F.col("_part") == F.col("_p3")))
    base, extra = F.floor(F.col("copies") / F.col("n")), F.col("copies") % F.col("n")
    return joined.select(
        F.col("id").alias(id), "size", "source_size", "target", "rate",
        (base + F.when(F.col("_rank") + F.col("_offset") < extra, 1).otherwise(0)).cast("long").alias("copies"),
    )


@keeps_columns
def mix_rows(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it; columns as given."""
    # rows are numbered once and staged, so that repeated rows keep apart
    marked = Scratch(docs.sparkSession, "mixed").stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    taken = mix(marked, id="_row", order=id, **options).where("copies > 0").select(F.col("_row").alias("_key"), F.col("copies").alias("_copies"))
    return marked.join(taken, F.col("_row") == F.col("_key")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def mix_report(docs: DataFrame) -> DataFrame:
    """The mix of the contract: doc_id, size, source_size, target, taken."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
