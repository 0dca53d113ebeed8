"""Column-expression building blocks (all JVM-side, no Python UDFs)."""

from strikeflow.functions.calendar import calendar_columns, season_of, order_key
from strikeflow.functions.stats import normal_cdf, std_normal_cdf
from strikeflow.functions.rounding import np_round
from strikeflow.functions.hours import (
    in_windows,
    outside_windows,
    late_outside,
    window_entry,
    weekday_eligible,
)

__all__ = [
    "calendar_columns",
    "season_of",
    "order_key",
    "normal_cdf",
    "std_normal_cdf",
    "np_round",
    "in_windows",
    "outside_windows",
    "late_outside",
    "window_entry",
    "weekday_eligible",
]
