"""Segmented scan: what every quarter hour needs from the ones before and behind it.

1. ``quarters`` reduces the zone table to one narrow row per zone and quarter,
   inside its partitioning.
2. ``scan`` turns the zone's series side by side into rows and runs the windows
   of a whole series, date or week over them: at most about a hundred rows per
   series and calendar day, however many ticks the day has.
3. ``gathered`` has one row per zone, date and hour, which joins back to the
   ticks where they lie (``dispatch``).

Durations are whole microseconds, so sums do not depend on where they are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.operators.constraints import constrained_dispatch, constrained_marker, within_daily_cap
from strikeflow.operators.zones import CHUNK, QUARTER, series_of_zone, with_rules
from strikeflow.params import Params

MIN_PER_SEC = 1.0 / 60.0
#: What a quarter gets per series: the flag before it; the event ordinal, and the longest duration of that
#: event, on its idle ticks (``in``) and on strike (``end``); what to add to ``cum_us`` for the running
#: duration of the event and of the constrained event; the constrained ordinal before it, whether its
#: first tick starts a constrained event; the day's and the week's qualifying events before it.
CARRY = ("prev", "e_in", "e_end", "m_in", "m_end", "base", "ce_in", "cfirst", "cbase", "d_in", "w_in")


def minutes(us: str) -> str:
    return f"({MIN_PER_SEC!r}D * (({us}) / 1e6D))"


def quarters(z: DataFrame, p: Params) -> DataFrame:
    """One row per zone and quarter: its length, and per series (by number) whether it strikes (``any``), at its
    first tick, after how long (``pre``), and the longest time so far on a strike tick; its constrained starts
    behind the first tick."""
    aggs = {"total": "sum(tick_us)", "day_start": "max(day_start)", "prev_hour": "max(CASE WHEN q_first THEN prev_hour END)"}
    for x, *_ in series_of_zone(p):
        aggs |= {
            f"any{x}": f"max(strike{x})",
            f"first{x}": f"max(CASE WHEN q_first THEN strike{x} END)",
            f"pre{x}": f"max(CASE WHEN strike{x} = 1 AND coalesce(was{x}, 0) = 0 THEN cum_us - tick_us END)",
            f"longest{x}": f"max(CASE WHEN strike{x} = 1 THEN cum_us END)",
            f"starts{x}": f"max(CASE WHEN q_last THEN starts{x} END)",
            f"last_start{x}": f"max(CASE WHEN q_last THEN last_start{x} END)",
        }
    return z.groupBy(*QUARTER).agg(*[F.expr(e).alias(name) for name, e in aggs.items()])


def scan(q: DataFrame, p: Params, edge: DataFrame | None = None, weeks: DataFrame | None = None) -> DataFrame:
    """The carries of every quarter and series (``CARRY``), and the week's count behind it (``w_end``).

    ``edge`` (zone_ord, x, last) and ``weeks`` (zone_ord, x, year, week, n) continue series that began in
    earlier data: the flag of the last tick before, and the events of weeks already begun."""
    parts = ("any", "first", "pre", "longest", "starts", "last_start")
    rows = ", ".join("named_struct('x', " + str(x) + "".join(f", '{c}', {c}{x}" for c in parts) + ")" for x, *_ in series_of_zone(p))
    kept = (*QUARTER, "total", "day_start", "prev_hour")
    s = q.select(*kept, F.expr(f"explode(array({rows}))").alias("s")).select(*kept, "s.*")
    s = with_rules(s.repartition("zone_ord", "x"), p)
    order = ("hour", "second_pass", "interval")
    whole = Window.partitionBy("zone_ord", "x").orderBy("date", *order)
    day = Window.partitionBy("zone_ord", "x", "date").orderBy(*order)
    upto, before = (day.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))

    def add(s: DataFrame, **columns: str) -> DataFrame:
        return s.withColumns({name: F.expr(e) for name, e in columns.items()})

    s = s.withColumn("prev", F.lag("any").over(whole))
    if edge is not None:
        s = add(s.join(F.broadcast(edge), ["zone_ord", "x"], "left"), prev="coalesce(prev, last)").drop("last")
    cdispatch = constrained_dispatch(p.dispatch_outside, "first", "CASE WHEN first = 1 AND prev = 0 THEN 1 ELSE 0 END")
    s = add(
        s,
        marker="CASE WHEN any = 0 OR (first = 1 AND NOT day_start AND coalesce(prev, 1) = 1) THEN 0 ELSE 1 END",
        cfirst=constrained_marker(p.dispatch_outside, "first", cdispatch, "day_start"),
    )
    s = s.withColumn("behind", F.sum("total").over(upto) - F.col("total"))
    s = add(s, begun="CASE WHEN marker = 1 THEN behind + pre END", n="starts + cfirst", cbegun="behind + coalesce(last_start, CASE WHEN cfirst = 1 THEN 0 END)")
    s = s.withColumns(
        {
            "e_end": F.sum("marker").over(upto),
            "ce_end": F.sum("n").over(upto),
            "open": F.last("begun", ignorenulls=True).over(before),
            "copen": F.last("cbegun", ignorenulls=True).over(before),
        }
    )
    s = add(s, e_in="e_end - marker", ce_in="ce_end - n", base="CASE WHEN marker = 1 THEN -pre ELSE behind - open END", cbase="behind - copen")
    event = Window.partitionBy("zone_ord", "x", "date", "e_end")
    s = s.withColumn("m_end", F.max(F.expr("CASE WHEN any = 1 THEN longest + base END")).over(event))
    # constrained events start on strike, so in the quarter's later event
    s = add(s, qualifying=f"CASE WHEN inside AND {minutes('m_end')} >= min_duration THEN n ELSE 0 END")
    s = s.withColumns({"m_in": F.lag("m_end").over(day), "d_end": F.sum("qualifying").over(upto)})
    s = add(s, d_in="d_end - qualifying")
    s = add(s, step=f"{within_daily_cap('d_end')} - {within_daily_cap('d_in')}")
    # the ISO week goes with the calendar year
    week = Window.partitionBy("zone_ord", "x", "year", "week").orderBy("date", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("w_end", F.sum("step").over(week))
    if weeks is not None:
        s = add(s.join(F.broadcast(weeks.withColumnRenamed("n", "w_old")), ["zone_ord", "x", "year", "week"], "left"), w_end="w_end + coalesce(w_old, 0)")
    return add(s, w_in="w_end - step").select(*QUARTER, "x", "year", "week", "any", "w_end", *CARRY)


def gathered(scanned: DataFrame) -> DataFrame:
    """The carries of a zone's series side by side: one row per (zone_ord, date, hour), ``_carried``: by quarter
    (interval, second_pass), at most eight of them, the carries by number."""
    carry = F.sort_array(F.collect_list(F.struct("x", *CARRY))).alias("carry")
    quarters = scanned.groupBy(*QUARTER).agg(carry)
    return quarters.groupBy(*CHUNK).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("interval", "second_pass"), "carry"))).alias("_carried"))
