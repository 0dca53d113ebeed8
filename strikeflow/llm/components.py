"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

MAX_ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours as ``m``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    star = _star(down)
    return (
        star.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .where("u <> v")
        .distinct()
    )


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v: long) but the roots themselves.

    The root is the component's least node.  Each round is written to the
    shared folder, so no round is computed twice and lineage stays short.
    Raises RuntimeError if the rounds don't settle, which the stars' bound of
    log-squared rounds excludes for any realistic size.
    """
    edges, mark = scratch.stage(links.select("u", "v").where("u <> v").distinct(), "edges-0"), None
    for i in range(1, MAX_ROUNDS):
        edges = scratch.stage(_small(_large(edges)), f"edges-{i}")
        scratch.drop(f"edges-{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("connected components did not settle")
