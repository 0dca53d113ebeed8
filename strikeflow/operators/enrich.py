"""Left joins that attach settlement prices, loss-of-load parameters,
strikes and constraints to every tick."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.functions.hours import weekday_eligible
from strikeflow.operators.settlement import KEYS


class DuplicateSeasonError(ValueError):
    pass


def distinct_lolp(lolp: DataFrame) -> DataFrame:
    """Season parameters without their date columns, duplicates removed."""
    return lolp.select("season", "lolp_mu", "lolp_sigma").dropDuplicates()


def check_lolp_unique(lolp_distinct: DataFrame) -> None:
    """More than one parameter row for a season would multiply ticks; refuse.

    Runs on the (tiny, seasonal) parameter table only."""
    dup = lolp_distinct.groupBy("season").count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise DuplicateSeasonError(f"season {dup[0]['season']!r} has more than one LOLP row")


def join_settlement(ticks: DataFrame, spp_wide: DataFrame) -> DataFrame:
    """Settlement prices per quarter hour.

    The wide table is first gathered to one row per (date, hour), at most
    eight quarter hours (four intervals, two passes), so that the join runs
    inside the ticks' (date, hour) partitioning and only this side moves."""
    prices = [c for c in spp_wide.columns if c not in KEYS]
    chunks = spp_wide.groupBy("date", "hour").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("interval", "repeated_hour"), F.struct(*prices)))).alias("_spp")
    )
    found = F.try_element_at(F.col("_spp"), F.struct("interval", "repeated_hour"))
    joined = ticks.join(chunks, ["date", "hour"], "left").withColumn("_spp", F.when(F.col("repeated_hour").isNotNull(), found))
    return joined.select(*ticks.columns, *[F.col("_spp")[c].alias(c) for c in prices])


def join_lolp(ticks: DataFrame, lolp_distinct: DataFrame) -> DataFrame:
    # at most one row per season (checked), four rows in all
    return ticks.join(F.broadcast(lolp_distinct), "season", "left")


def join_month_params(ticks: DataFrame, strikes: DataFrame, constraints: DataFrame) -> DataFrame:
    # 12-row parameter tables
    out = ticks.join(F.broadcast(strikes), "month", "left").join(F.broadcast(constraints), "month", "left")
    return out.withColumn("weekday_ok", weekday_eligible(F.col("weekday")))
