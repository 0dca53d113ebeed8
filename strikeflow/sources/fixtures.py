"""Derive market-shaped inputs from the shared test tables.

No market data ships with the tests, so the ``events`` table is mapped onto
the tick / settlement schemas by plain arithmetic (the mapping is described in
FIXTURES.md §2).  Everything stays a DataFrame expression over ``events``: the
inputs grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow import schemas
from strikeflow.functions.calendar import quarter_hour

# Fixed values of the fixture mapping (FIXTURES.md §2).
ZONE_FACTORS = {
    "hb_north": 1.05,
    "lz_north": 1.00,
    "lz_houston": 1.10,
    "lz_south": 0.90,
    "lz_west": 1.25,
}
# (point name, point type, price factor); the last two rows must be filtered out
SETTLEMENT_POINTS = (
    ("HB_NORTH", "HU", 1.05),
    ("LZ_NORTH", "LZ", 1.00),
    ("LZ_HOUSTON", "LZ", 1.10),
    ("LZ_SOUTH", "LZ", 0.90),
    ("LZ_WEST", "LZ", 1.25),
    ("LZ_NORTH", "LZEW", 3.00),
    ("LZ_OTHER", "LZ", 0.50),
)
# (season, start date, end date, start hour, end hour, mu, sigma); each season
# twice with different dates so that the distinct step has work to do
LOLP_ROWS = (
    ("Winter", "12/01/2023", "02/28/2024", 0, 23, 1000.0, 1200.0),
    ("Winter", "12/01/2024", "02/28/2025", 0, 23, 1000.0, 1200.0),
    ("Spring", "03/01/2024", "05/31/2024", 0, 23, 900.0, 1100.0),
    ("Spring", "03/01/2025", "05/31/2025", 0, 23, 900.0, 1100.0),
    ("Summer", "06/01/2024", "08/31/2024", 0, 23, 1100.0, 1300.0),
    ("Summer", "06/01/2025", "08/31/2025", 0, 23, 1100.0, 1300.0),
    ("Fall", "09/01/2024", "11/30/2024", 0, 23, 950.0, 1150.0),
    ("Fall", "09/01/2025", "11/30/2025", 0, 23, 950.0, 1150.0),
)
BLOCK_DAYS = 3
BLOCK_SHIFT_DAYS = 70
# one block is moved on to the days around the end of daylight saving time,
# whose hour 1 comes twice; odd k are ticks of its second pass
AUTUMN_BLOCK, AUTUMN_SHIFT_DAYS = 4, 14
REPEATED_HOUR = "2024-11-03 01:00:00"
SKIP_MODULUS = 29


def _shifted_ts(ts: Column) -> Column:
    """Whole seconds, every block of three source days moved 70 days on, and one to the autumn's clock change."""
    base = F.date_trunc("second", ts).cast("timestamp_ntz")
    block = F.floor((F.dayofmonth(ts) - 1) / BLOCK_DAYS)
    shift = block * BLOCK_SHIFT_DAYS + F.when(block == AUTUMN_BLOCK, AUTUMN_SHIFT_DAYS).otherwise(0)
    return base + F.expr("INTERVAL '1' DAY") * shift.cast("int")


def _repeated(ts: Column, k: Column) -> Column:
    """'Y' for the second pass of the repeated hour, else 'N'."""
    start = F.lit(REPEATED_HOUR).cast("timestamp_ntz")
    return F.when((F.date_trunc("hour", ts).cast("timestamp_ntz") == start) & (k % 2 == 1), F.lit("Y")).otherwise(F.lit("N"))


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def ticks_from_events(events: DataFrame) -> DataFrame:
    v = F.col("value")
    k = _k(F.col("props"))
    cols = {
        "tick_id": F.col("event_id"),
        "ts": _shifted_ts(F.col("ts")),
        "repeated_hour": _repeated(_shifted_ts(F.col("ts")), k),
        **{z: (F.lit(2.0) * v) * F.lit(f) for z, f in ZONE_FACTORS.items()},
        "system_lambda": F.lit(40.0) * v,
        "rtorpa": k / F.lit(10.0),
        "rtoffpa": k / F.lit(20.0),
        "rtordpa": (k % 7) / F.lit(10.0),
        "rtolcap": F.lit(2500.0) + F.lit(150.0) * k,
        "rtoffcap": F.lit(10.0) * k,
    }
    return events.select(*[c.alias(n) for n, c in cols.items()]).select(
        *[F.col(f.name).cast(f.dataType) for f in schemas.TICK.fields]
    )


def prices_from_events(events: DataFrame) -> DataFrame:
    """The ticks' energy prices as a long table: one row per tick and point."""
    points = F.explode(F.array(*[F.struct(F.lit(z.upper()).alias("point"), F.lit(f).alias("f")) for z, f in ZONE_FACTORS.items()]))
    rows = events.select(F.col("event_id").alias("tick_id"), _shifted_ts(F.col("ts")).alias("ts"), F.col("value").alias("v"), points.alias("p"))
    return rows.select(F.col("tick_id").cast("long").alias("tick_id"), "ts", "p.point", ((F.lit(2.0) * F.col("v")) * F.col("p.f")).alias("lmp"))


def settlement_from_events(events: DataFrame) -> DataFrame:
    """One settlement row per event and point; all events are read once."""
    # whole days are added to the time, so its hour and minute are the event's
    kept = ((F.hour("ts") * 4 + quarter_hour(F.minute("ts"))) % SKIP_MODULUS) != 0
    ts = _shifted_ts(F.col("ts"))
    base = events.filter(kept).select(ts.alias("t"), F.col("value").alias("v"), _k(F.col("props")).alias("k")).select(
        F.date_format("t", "MM/dd/yyyy").alias("delivery_date"),
        F.hour("t").alias("h"),
        quarter_hour(F.minute("t")).alias("delivery_interval"),
        _repeated(F.col("t"), F.col("k")).alias("repeated_hour"),
        "v",
    )
    points = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("point_name"), F.lit(t).alias("point_type"), F.lit(f).alias("f"))
                for n, t, f in SETTLEMENT_POINTS
            ]
        )
    ).alias("p")
    rows = base.select("*", points).select(
        "delivery_date",
        (F.col("h") + 1).alias("delivery_hour"),
        "delivery_interval",
        "repeated_hour",
        "p.point_name",
        "p.point_type",
        ((F.lit(2.5) * F.col("v")) * F.col("p.f")).alias("price"),
    )
    return rows.select(*[f.name for f in schemas.SETTLEMENT.fields])


def lolp_fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOLP_ROWS), schemas.LOLP)


def load_fixture(spark: SparkSession, sf_dir: str):
    """(ticks, settlement, lolp) derived from ``{sf_dir}/events.parquet``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ticks_from_events(events), settlement_from_events(events), lolp_fixture(spark)
