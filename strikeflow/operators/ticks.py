"""Tick preparation: calendar, ordering, tick lengths, quarter-hour weights.

Partitioning: the tick table is hash-partitioned by (date, hour) once
(``partition_by_chunk``); every tick-level window below is partitioned by
(date, hour) or (date, hour, interval), so none of them adds a shuffle and a
busy day still splits 24 ways.  What crosses an hour boundary (next tick's
timestamp, previous tick's hour and date) comes from a per-hour summary of at
most 24 rows per calendar day, joined on (date, hour): the tick side is
partitioned by these keys already, so only the summary moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.functions.calendar import calendar_columns, order_key, second_pass
from strikeflow.params import Params

ORDER = ("ord_ts", "tick_id")


def with_calendar(ticks: DataFrame, p: Params) -> DataFrame:
    """Calendar columns plus the ordering instant ``ord_ts`` and ``second_pass`` (1 in the second pass of a repeated hour)."""
    args = (F.col("ts"), F.col("repeated_hour"), p.timezone, p.repeated_flag)
    return calendar_columns(ticks).withColumns({"ord_ts": order_key(*args), "second_pass": second_pass(*args).cast("int")})


CHUNK = ("date", "hour")


def partition_by_chunk(df: DataFrame, n: int) -> DataFrame:
    """The single shuffle of the tick table, into a fixed number of partitions:
    the work after it (windows, and a row per zone) is heavy per byte, so
    size-based coalescing of the shuffle would starve it of tasks."""
    return df.repartition(n, *CHUNK)


def chunk_summary(ticks: DataFrame, p: Params, edge=None) -> DataFrame:
    """Per (date, hour), what its ticks need from the hours around it: the
    first timestamp of the next hour present, hour and date of the previous
    one, and the latest month of all ticks.

    One map-side hash aggregate reads the unshuffled ticks; the un-partitioned
    window runs over at most 24 rows per calendar day.  ``edge`` (date, hour,
    month) continues earlier data: its last hour and its latest month.
    """
    first_pass = F.when(~F.coalesce(F.col("repeated_hour") == p.repeated_flag, F.lit(False)), F.col("ts"))
    chunks = ticks.groupBy(*CHUNK).agg(F.coalesce(F.min(first_pass), F.min("ts")).alias("first_ts"))
    w = Window.orderBy(*CHUNK)
    date, hour, month = edge or (None, None, None)
    return chunks.select(
        *CHUNK,
        F.lead("first_ts").over(w).alias("next_chunk_first_ts"),
        F.coalesce(F.lag("hour").over(w), F.lit(hour).cast("int")).alias("prev_chunk_hour"),
        F.coalesce(F.lag("date").over(w), F.lit(date).cast("date")).alias("prev_chunk_date"),
        F.greatest(F.max(F.month("date")).over(Window.partitionBy()), F.lit(month).cast("int")).alias("last_month"),
    )


def with_tick_seconds_joined(ticks: DataFrame) -> DataFrame:
    """Given ticks joined with ``chunk_summary``: tick_us and tick_secs (local-clock
    time to the next tick, as whole microseconds and as seconds; the very last
    tick runs to the end of its hour), day_start (first tick of its date) and prev_hour (previous tick's hour)."""
    w = Window.partitionBy(*CHUNK).orderBy(*ORDER)
    nxt = F.coalesce(F.lead("ts").over(w), F.col("next_chunk_first_ts"))
    prv = F.lag("hour").over(w)
    last = (F.lit(60) - F.col("minute")) * F.lit(60_000_000).cast("long")
    us = F.when(nxt.isNull(), last).otherwise(F.timestamp_diff("MICROSECOND", F.col("ts"), nxt))
    first_in_chunk = prv.isNull()
    new_day = F.col("prev_chunk_date").isNull() | (F.col("prev_chunk_date") != F.col("date"))
    return ticks.withColumns(
        {
            "tick_us": us,
            "tick_secs": us / F.lit(1e6),
            "day_start": first_in_chunk & new_day,
            "prev_hour": F.coalesce(prv, F.col("prev_chunk_hour")),
        }
    ).drop("next_chunk_first_ts", "prev_chunk_hour", "prev_chunk_date")


def with_interval_seconds(ticks: DataFrame) -> DataFrame:
    """interval_secs: tick seconds summed over the tick's quarter hour (date,
    hour, interval; both passes of a repeated hour together); weight: the
    tick's share of it (NULL for a zero-length quarter hour)."""
    total = F.sum("tick_secs").over(Window.partitionBy("date", "hour", "interval"))
    return ticks.withColumns({"interval_secs": total, "weight": F.try_divide(F.col("tick_secs"), total)})
