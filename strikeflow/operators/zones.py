"""Zone table: one row per tick and load zone, the series of a zone side by side.

A series is a (scenario, strike case) of a zone; its columns are numbered
(``strike0`` ... ``strike5``: both scenarios, three cases each).  The table is
hash-partitioned by (zone, date, hour), so a busy date splits by zone and hour,
and sorted once: every window here is partitioned by a prefix of
``QUARTER`` and ordered by what is left of (second_pass, ord_ts, tick_id).

A *quarter* is one pass of one quarter hour, an unbroken stretch of ticks.  The
strike flag is sticky within the quarter hour, so a quarter is idle up to some
tick and on strike from there: an unconstrained event can only begin once in it.
Nothing here looks beyond the quarter hour; what the quarters before and behind
decide comes from ``carries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeflow.functions.hours import in_windows, late_outside, outside_windows, weekday_eligible, window_entry
from strikeflow.operators.constraints import constrained_dispatch, constrained_marker
from strikeflow.params import SCENARIOS, Params, constraint_table, local_rows, strike_table

CHUNK = ("zone_ord", "date", "hour")
QUARTER = (*CHUNK, "interval", "second_pass")
ORDER = ("ord_ts", "tick_id")
#: Tick columns that the zone table's shuffle moves.
MOVED = ("tick_id", "ord_ts", "date", "hour", "interval", "second_pass", "repeated_hour", "tick_us", "weight", "day_start", "prev_hour", "last_month")


def series_of_zone(p: Params) -> list[tuple[int, int, int]]:
    """(number, scenario ordinal, case ordinal) of the series side by side."""
    return [(si * len(p.cases) + ci, si, ci) for si in range(len(SCENARIOS)) for ci in range(len(p.cases))]


def by_zone(ticks: DataFrame, p: Params, zones=None) -> DataFrame:
    """Ticks with a column per zone -> a row per zone with its energy price ``lmp`` (a narrow operator)."""
    wanted = [(i, z) for i, z in enumerate(p.zones) if not zones or z in zones]
    rows = F.array(*[F.struct(F.lit(i).alias("zone_ord"), F.col(z).alias("lmp")) for i, z in wanted])
    kept = [c for c in ticks.columns if c not in p.zones]
    return ticks.select(*kept, F.explode(rows).alias("_z")).select(*kept, "_z.*")


def zone_ordinals(spark: SparkSession, p: Params, zones=None) -> DataFrame:
    """point, zone_ord: the wanted zones' points by name; its size is that of the parameters."""
    rows = [(point, p.zones.index(z)) for point, z in p.points.items() if z in p.zones and (not zones or z in zones)]
    return local_rows(spark, rows, T.StructType([T.StructField("point", T.StringType()), T.StructField("zone_ord", T.IntegerType())]))


def with_prices(ticks: DataFrame, prices: DataFrame, p: Params, zones=None) -> DataFrame:
    """Ticks and a long price table (tick_id, ts, point, lmp) -> a row per zone, as ``by_zone``.

    Both meet on (date, hour) and the tick; the ticks are partitioned by (date, hour) already.  ``ts`` is the
    tick's local time.  A price without a tick, or of an unwanted point, is left out, and so is a tick without a price."""
    ordinals = F.broadcast(zone_ordinals(ticks.sparkSession, p, zones))
    long = prices.select(F.to_date("ts").alias("date"), F.hour("ts").alias("hour"), "tick_id", "point", "lmp").join(ordinals, "point").drop("point")
    return ticks.drop("lmp", "zone_ord").join(long, ["date", "hour", "tick_id"])


def point_prices(z: DataFrame) -> DataFrame:
    """price0 = energy price and published adders, price1 = the price under the new reserve curve."""
    lmp = F.col("lmp")
    return z.withColumns(
        {
            "price0": lmp + F.col("rtorpa") + F.col("rtordpa"),
            "price1": (lmp - (F.col("system_lambda") - F.col("lambda_capped"))) + F.col("new_rtorpa"),
        }
    )


def partition_zones(z: DataFrame, n: int, together: bool = False) -> DataFrame:
    """The zone table's one shuffle, of its narrow form, into a fixed number of partitions (see ``ticks.partition_by_chunk``).

    ``together``: what isn't a key moves as one column, ``_tick``, which the windows order by last.  Carries and series need
    different columns of it, but then ask for the same shuffle; in one plan Spark makes its rows once for both."""
    rest = [c for c in (*MOVED, "price0", "price1") if c not in (*QUARTER, "ord_ts")]
    if not together:
        return z.select(*QUARTER, "ord_ts", *rest).repartition(n, *CHUNK)
    moved = z.select(*QUARTER, "ord_ts", F.struct(*rest).alias("_tick")).repartition(n, *CHUNK)
    return moved.select("*", "_tick.*")


def _order(z: DataFrame) -> tuple[str, ...]:
    """``ORDER``, and ``_tick``, which decides nothing where a tick_id comes once."""
    return (*ORDER, "_tick") if "_tick" in z.columns else ORDER


def with_rules(t: DataFrame, p: Params) -> DataFrame:
    """Calendar parts, strikes, constraints and window tests of a row's date and hour (12-row tables, broadcast)."""
    spark = t.sparkSession
    t = t.withColumns({"year": F.year("date"), "month": F.month("date"), "day": F.dayofmonth("date"), "week": F.weekofyear("date")})
    t = t.join(F.broadcast(strike_table(spark, p)), "month", "left").join(F.broadcast(constraint_table(spark, p)), "month", "left")
    hour = F.col("hour")
    return t.withColumns(
        {
            "weekday_ok": weekday_eligible(F.weekday("date")),
            "inside": in_windows(hour),
            "outside": outside_windows(hour),
            "late_out": late_outside(hour),
            "entry": window_entry(hour, F.col("prev_hour"), p.window_entry),
        }
    )


def with_strikes(z: DataFrame, p: Params) -> DataFrame:
    """Price above the row month's strike (a missing price is not), sticky for the rest of its quarter hour
    (both passes of a repeated one)."""
    w = Window.partitionBy(*CHUNK, "interval").orderBy("second_pass", *_order(z)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return z.withColumns({f"strike{x}": F.max(F.expr(f"CASE WHEN price{si} > {p.cases[ci]}_lmp THEN 1 ELSE 0 END")).over(w) for x, si, ci in series_of_zone(p)})


def with_new_spp(z: DataFrame) -> DataFrame:
    """spp1 = the time-weighted quarter-hour price under the new curve (an all-NULL quarter hour sums to 0)."""
    w = Window.partitionBy(*CHUNK, "interval")
    return z.withColumn("spp1", F.coalesce(F.sum(F.col("price1") * F.col("weight")).over(w), F.lit(0.0)))


def with_hours(z: DataFrame, gathered: DataFrame, settled: DataFrame) -> DataFrame:
    """Carries (``carries.gathered``: all hours of ``z``) and settlement prices (``settlement.by_chunk``), a row per
    zone, date and hour each: they are put together first, and join inside the zone table's partitioning.

    By the quarter the tables would have to be partitioned by all of its columns, so the ticks would be moved again."""
    return z.join(gathered.join(settled, list(CHUNK), "left"), list(CHUNK), "left")


def with_settlement(z: DataFrame) -> DataFrame:
    """spp0 = the settlement price, NULL if there is none, of the hour's (``with_hours``)."""
    found = F.try_element_at(F.col("_settled"), F.struct("interval", "repeated_hour"))
    return z.withColumn("spp0", F.when(F.col("repeated_hour").isNotNull(), found)).drop("_settled")


def with_local(z: DataFrame, p: Params) -> DataFrame:
    """What a quarter knows of itself, as of each tick: its seconds so far (``cum_us``, microseconds), its
    first and last tick, and per series the flag before (``was``), the constrained starts so far but for
    the first tick's (``starts``), and where the last of them was (``last_start``)."""
    w = Window.partitionBy(*QUARTER).orderBy(*_order(z))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbers = [x for x, *_ in series_of_zone(p)]
    z = z.withColumns(
        {
            "cum_us": F.sum("tick_us").over(so_far),
            "q_first": F.lag(F.lit(1)).over(w).isNull(),
            "q_last": F.lead(F.lit(1)).over(w).isNull(),
            **{f"was{x}": F.lag(f"strike{x}").over(w) for x in numbers},
        }
    )
    starts = {}
    for x in numbers:
        # later ticks of a quarter are never the first of their date
        cdispatch = constrained_dispatch(p.dispatch_outside, f"strike{x}", f"CASE WHEN strike{x} = 1 AND was{x} = 0 THEN 1 ELSE 0 END")
        starts[x] = constrained_marker(p.dispatch_outside, f"strike{x}", cdispatch, "false")
    z = z.withColumns({f"starts_here{x}": F.expr(f"CASE WHEN q_first THEN 0 ELSE {s} END") for x, s in starts.items()})
    return z.withColumns(
        {f"starts{x}": F.sum(f"starts_here{x}").over(so_far) for x in numbers}
        | {f"last_start{x}": F.last(F.expr(f"CASE WHEN starts_here{x} = 1 THEN cum_us - tick_us END"), ignorenulls=True).over(so_far) for x in numbers}
    ).drop(*[f"starts_here{x}" for x in numbers])
