"""Model parameters: strikes, contract constraints and market scalars.

One frozen dataclass replaces the editable constants of the original model.
The per-month tables become 12-row DataFrames (``strike_table`` /
``constraint_table``) that are broadcast-joined on ``month``; their size is
fixed by the calendar, so the broadcast is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the original model's inputs for equal results.
# Strike prices in $/MWh by month, each (low, mid, high).
DEFAULT_STRIKES_SPP = {
    1: (100.0, 150.0, 200.0), 2: (100.0, 150.0, 200.0), 3: (55.0, 80.0, 110.0),
    4: (55.0, 80.0, 110.0), 5: (55.0, 80.0, 110.0), 6: (100.0, 150.0, 200.0),
    7: (100.0, 150.0, 200.0), 8: (100.0, 150.0, 200.0), 9: (100.0, 150.0, 200.0),
    10: (55.0, 80.0, 110.0), 11: (55.0, 80.0, 110.0), 12: (100.0, 150.0, 200.0),
}
DEFAULT_STRIKES_LMP = {
    1: (200.0, 400.0, 550.0), 2: (200.0, 400.0, 550.0), 3: (140.0, 200.0, 300.0),
    4: (140.0, 200.0, 300.0), 5: (140.0, 200.0, 300.0), 6: (200.0, 400.0, 550.0),
    7: (200.0, 400.0, 550.0), 8: (200.0, 400.0, 550.0), 9: (200.0, 400.0, 550.0),
    10: (140.0, 200.0, 300.0), 11: (140.0, 200.0, 300.0), 12: (200.0, 400.0, 550.0),
}
# Constraints, the same for every month (see MonthConstraints defaults):
#   daily events max 10, weekly events max 100, event duration min 11 and
#   max 360 minutes, event windows hours [0, 5) and [22, 24), eligible
#   weekdays Monday..Sunday 1 1 1 1 1 1 1.
# Scalars: value of lost load 5000, minimum contingency level 3000, system
#   lambda cap 5001, initial dispatch capture 0.2, dispatch outside event
#   window False.
# Seasons by month: 3-5 Spring, 6-8 Summer, 9-11 Fall, otherwise Winter.
# Settlement points kept: HB_NORTH LZ_NORTH LZ_HOUSTON LZ_SOUTH LZ_WEST;
#   point types kept: HU, LZ and the empty string.
# ---------------------------------------------------------------------------

ZONES = ("lz_north", "lz_houston", "lz_south", "lz_west")
CASES = ("low", "mid", "high")
SCENARIOS = ("base", "new_ordc")
# settlement point name in the source -> Spark column prefix
POINTS = {
    "HB_NORTH": "hb_north",
    "LZ_NORTH": "lz_north",
    "LZ_HOUSTON": "lz_houston",
    "LZ_SOUTH": "lz_south",
    "LZ_WEST": "lz_west",
}
POINT_TYPES = ("HU", "LZ", "")
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class MonthConstraints:
    daily_max: int = 10
    weekly_max: int = 100
    min_duration: float = 11.0
    max_duration: float = 360.0
    w1_start: int = 0
    w1_end: int = 5
    w2_start: int = 22
    w2_end: int = 24
    days: tuple[int, int, int, int, int, int, int] = (1, 1, 1, 1, 1, 1, 1)


@dataclass(frozen=True)
class Params:
    voll: float = 5000.0
    mcl: float = 3000.0
    lambda_cap: float = 5001.0
    capture_pct: float = 0.2
    dispatch_outside: bool = False
    strikes_spp: dict = field(default_factory=lambda: dict(DEFAULT_STRIKES_SPP))
    strikes_lmp: dict = field(default_factory=lambda: dict(DEFAULT_STRIKES_LMP))
    constraints: dict = field(
        default_factory=lambda: {m: MonthConstraints() for m in range(1, 13)}
    )
    zones: tuple[str, ...] = ZONES
    # settlement point -> zone (or hub), for all points that are read
    points: dict = field(default_factory=lambda: dict(POINTS))
    cases: tuple[str, ...] = CASES
    # 'last_month': valuation strike of the last month present in the data,
    # for every row (as the original computes it); 'row_month': the row's month.
    strike_basis: str = "last_month"
    # 'as_written': a strike tick enters a window when the previous tick's hour
    # is below either window start; 'boundary': previous hour outside the window.
    window_entry: str = "as_written"
    # wall-clock zone of tick timestamps, and the repeated-hour flag value that
    # marks the second pass of the autumn repeated hour
    timezone: str = "America/Chicago"
    repeated_flag: str = "Y"

    def with_constraints(self, **changes) -> "Params":
        """Same parameters with some constraint fields changed in every month."""
        new = {m: replace(c, **changes) for m, c in self.constraints.items()}
        return replace(self, constraints=new)

    def with_options(self, **changes) -> "Params":
        return replace(self, **changes)


STRIKE_SCHEMA = T.StructType(
    [T.StructField("month", T.IntegerType(), False)]
    + [T.StructField(f"{c}_{k}", T.DoubleType(), False) for k in ("spp", "lmp") for c in CASES]
)

CONSTRAINT_SCHEMA = T.StructType(
    [
        T.StructField("month", T.IntegerType(), False),
        T.StructField("daily_max", T.IntegerType(), False),
        T.StructField("weekly_max", T.IntegerType(), False),
        T.StructField("min_duration", T.DoubleType(), False),
        T.StructField("max_duration", T.DoubleType(), False),
        T.StructField("w1_start", T.IntegerType(), False),
        T.StructField("w1_end", T.IntegerType(), False),
        T.StructField("w2_start", T.IntegerType(), False),
        T.StructField("w2_end", T.IntegerType(), False),
    ]
    + [T.StructField(d, T.IntegerType(), False) for d in WEEKDAYS]
)


def local_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Rows that become part of the plan: no job has to read them."""
    kinds = {T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string()}
    columns = [pa.array([r[i] for r in rows], kinds[type(f.dataType)]) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.table(columns, names=schema.names), schema)


def strike_table(spark: SparkSession, p: Params) -> DataFrame:
    """12-row strike dimension: month, low/mid/high_spp, low/mid/high_lmp."""
    return local_rows(spark, [(m, *p.strikes_spp[m], *p.strikes_lmp[m]) for m in range(1, 13)], STRIKE_SCHEMA)


def constraint_table(spark: SparkSession, p: Params) -> DataFrame:
    """12-row constraint dimension: caps, durations, hour windows, weekdays."""
    rows = []
    for m in range(1, 13):
        c = p.constraints[m]
        rows.append(
            (m, c.daily_max, c.weekly_max, float(c.min_duration), float(c.max_duration),
             c.w1_start, c.w1_end, c.w2_start, c.w2_end, *c.days)
        )
    return local_rows(spark, rows, CONSTRAINT_SCHEMA)
