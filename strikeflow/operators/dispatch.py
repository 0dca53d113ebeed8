"""Dispatch, events, durations and values of each tick, from the zone table's
local columns and its quarter's carries; no window is left to run.

A tick's series are made rows before anything is worked out for them: side by side they
would be far more columns than Spark generates code for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeflow.operators.carries import CARRY, minutes
from strikeflow.operators.constraints import constrained_dispatch, constrained_duration, constrained_marker, within_daily_cap
from strikeflow.operators.zones import series_of_zone
from strikeflow.params import Params

#: Columns that a series gets.
SERIES_COLUMNS = (
    "strike", "prev_strike", "dispatch", "event", "duration", "event_max_duration", "cdispatch", "cmarker", "cevent",
    "cduration_raw", "qualifying", "daily", "weekly", "cduration", "part", "cpart",
)


def with_carries(z: DataFrame) -> DataFrame:
    """``carry`` = the carries of a row's quarter, of its hour's (``zones.with_hours``)."""
    return z.withColumn("carry", F.try_element_at(F.col("_carried"), F.struct("interval", "second_pass"))).drop("_carried")


def event(strike: str, carry: str = "") -> str:
    return f"nullif(CASE WHEN {strike} = 1 THEN {carry}e_end ELSE {carry}e_in END, 0)"


def constrained_event(starts: str, carry: str = "") -> str:
    return f"nullif({carry}ce_in + {carry}cfirst + {starts}, 0)"


def picked(numbers: Sequence[int], columns: Callable[[int], str]) -> str:
    """The value that a series' row takes, by its number."""
    return "CASE x " + " ".join(f"WHEN {x} THEN {columns(x)}" for x in numbers) + " END"


def series_rows(z: DataFrame, p: Params, numbers: Sequence[int], wanted: str = "true") -> DataFrame:
    """The zone table's rows (``with_carries``, ``with_settlement``) once per series of the given ``numbers`` (``x``), a narrow step,
    with the series' price, settlement price and columns; only the rows that are ``wanted``, by ``x`` and ``strike``.

    ``part`` and ``cpart`` are the shares of the tick's gain that its unconstrained and constrained value have:
    the tick where the strike turns on only captures ``capture_pct``."""
    scenario = {x: si for x, si, _ in series_of_zone(p)}
    rows = z.withColumn("x", F.explode(F.array(*[F.lit(x) for x in numbers])))
    own = {name: picked(numbers, lambda x, n=name: f"{n}{x}") for name in ("strike", "was", "starts", "last_start")}
    own |= {name: picked(numbers, lambda x, n=name: f"{n}{scenario[x]}") for name in ("price", "spp")}
    rows = rows.withColumn("strike", F.expr(own.pop("strike"))).filter(wanted)
    for step in (own, *_steps(p)):
        rows = rows.withColumns({name: F.expr(e) for name, e in step.items()})
    return rows


def _steps(p: Params) -> list[dict[str, str]]:
    """The columns to add, in turn, as SQL text."""
    out = p.dispatch_outside
    # qualifying events of the quarter so far: starts are on strike, so in the event whose longest duration is m_end
    counted = f"(d_in + CASE WHEN inside AND {minutes('m_end')} >= min_duration THEN starts + cfirst ELSE 0 END)"
    return [
        {name: f"carry[x].{name}" for name in CARRY} | {"prev_strike": "CASE WHEN q_first THEN carry[x].prev ELSE was END"},
        {
            "dispatch": "CASE WHEN strike = 1 AND prev_strike = 0 THEN 1 ELSE 0 END",
            "event": event("strike"),
            "cevent": constrained_event("starts"),
            "daily": f"nullif({counted}, 0)",
            "weekly": f"nullif(w_in + {within_daily_cap(counted)} - {within_daily_cap('d_in')}, 0)",
        },
        {
            "duration": f"CASE WHEN strike = 1 AND event IS NOT NULL THEN {minutes('cum_us + base')} END",
            "event_max_duration": f"CASE WHEN event IS NOT NULL THEN {minutes('CASE WHEN strike = 1 THEN m_end ELSE m_in END')} END",
            "cduration_raw": "CASE WHEN strike = 1 AND cevent IS NOT NULL THEN "
            + minutes("cum_us + coalesce(-last_start, CASE WHEN cfirst = 1 THEN 0 ELSE cbase END)")
            + " END",
            "cdispatch": constrained_dispatch(out, "strike", "dispatch"),
            "part": f"CASE WHEN dispatch = 1 THEN {p.capture_pct!r}D ELSE double(strike) END",
        },
        {
            "cmarker": constrained_marker(out, "strike", "cdispatch", "day_start"),
            "cduration": constrained_duration(out, "cduration_raw", "duration", "daily", "weekly"),
        },
        {
            "qualifying": "CASE WHEN event_max_duration >= min_duration AND inside AND cmarker = 1 THEN 1 ELSE 0 END",
            "cpart": "CASE WHEN cduration IS NOT NULL THEN part ELSE 0.0D END",
        },
    ]
