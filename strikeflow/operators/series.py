"""Series: names, valuation strikes, and the long table (one row per tick,
zone, scenario and strike case) made from the zone table.

The long table is the last, narrow step (an ``explode`` of a fixed array);
nothing is shuffled or written in this form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.operators.dispatch import SERIES_COLUMNS, picked, series_rows
from strikeflow.operators.zones import series_of_zone
from strikeflow.params import SCENARIOS, Params

#: Columns of a tick and zone on every row of the long table.
TICK_KEEP = (
    "tick_id", "ord_ts", "date", "year", "month", "day", "week", "hour", "interval", "day_start", "weight",
    "weekday_ok", "daily_max", "weekly_max", "min_duration", "max_duration", "inside", "outside", "late_out", "entry", "zone_ord",
)


def valuation_strike(p: Params, case: int) -> str:
    """Settlement-price strike of a case that values a tick, as SQL text."""
    return f"element_at(array({', '.join(f'{float(p.strikes_spp[m][case])!r}D' for m in range(1, 13))}), {valuation_month(p)})"


def valuation_month(p: Params) -> str:
    """The column of the month whose strike values a tick: 'row_month', its own; 'last_month', the latest present anywhere in the data."""
    if p.strike_basis not in ("row_month", "last_month"):
        raise ValueError(f"unknown strike_basis {p.strike_basis!r}")
    return "month" if p.strike_basis == "row_month" else "last_month"


def named(values: Sequence[str], ordinal: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ordinal + 1)


def to_series(z: DataFrame, p: Params, scenarios=None, columns=None) -> DataFrame:
    """The long table with values: $/MW = (spp - strike) x share of the quarter hour x 0.25 h x the captured part.

    ``columns``: the series columns to make, beside the keys (default: all)."""
    scen, case = ({x: made[i] for x, *made in series_of_zone(p)} for i in (0, 1))
    numbers = [x for x in scen if not scenarios or SCENARIOS[scen[x]] in scenarios]
    rows = series_rows(z, p, numbers).withColumns(
        {
            "zone": named(p.zones, F.col("zone_ord")),
            "scen_ord": F.expr(picked(numbers, lambda x: str(scen[x]))),
            "case_ord": F.expr(picked(numbers, lambda x: str(case[x]))),
            "k_spp": F.expr(picked(numbers, lambda x: valuation_strike(p, case[x]))),
        }
    )
    gain, quarter = "(spp - k_spp)", "* 0.25D * weight"
    rows = rows.withColumns(
        {
            "scenario": named(SCENARIOS, F.col("scen_ord")),
            "strike_case": named(p.cases, F.col("case_ord")),
            "value": F.expr(f"part * {gain} {quarter}"),
            "cvalue": F.expr(f"CASE WHEN cduration IS NOT NULL THEN cpart * {gain} ELSE 0.0D END {quarter}"),
        }
    )
    made = ["scenario", "strike_case", "scen_ord", "case_ord", "price", "spp", "k_spp", *[c for c in SERIES_COLUMNS if c not in ("part", "cpart")], "value", "cvalue"]
    return rows.select(*TICK_KEEP, "zone", *[c for c in made if columns is None or c in columns or c in ("scenario", "strike_case")])
