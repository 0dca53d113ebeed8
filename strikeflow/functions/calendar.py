"""Calendar columns derived from the local wall-clock tick timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.params import WEEKDAY_NAMES


def season_of(month: Column) -> Column:
    return (
        F.when((month >= 3) & (month <= 5), F.lit("Spring"))
        .when((month >= 6) & (month <= 8), F.lit("Summer"))
        .when((month >= 9) & (month <= 11), F.lit("Fall"))
        .otherwise(F.lit("Winter"))
    )


def quarter_hour(minute: Column) -> Column:
    """Settlement interval 1..4 of the hour."""
    return (
        F.when(minute < 15, F.lit(1))
        .when(minute < 30, F.lit(2))
        .when(minute < 45, F.lit(3))
        .otherwise(F.lit(4))
    )


def second_pass(ts: Column, repeated_hour: Column, timezone: str, second_pass_flag: str) -> Column:
    """Is a tick flagged as the second pass of the autumn repeated hour, in that hour?

    The hour is ambiguous if the instant one hour later shows the same wall
    clock; a flag on any other hour changes nothing.
    """
    later = F.convert_timezone(F.lit(timezone), F.lit("UTC"), ts) + F.expr("INTERVAL 1 HOUR")
    again = F.convert_timezone(F.lit("UTC"), F.lit(timezone), later) == ts
    return F.coalesce((repeated_hour == F.lit(second_pass_flag)) & again, F.lit(False))


def order_key(ts: Column, repeated_hour: Column, timezone: str, second_pass_flag: str) -> Column:
    """Instant of a wall-clock tick, used only to order ticks.

    ``convert_timezone`` resolves the ambiguous autumn hour to its first pass;
    rows of the second pass are moved one hour later.
    """
    utc = F.convert_timezone(F.lit(timezone), F.lit("UTC"), ts)
    return F.when(second_pass(ts, repeated_hour, timezone, second_pass_flag), utc + F.expr("INTERVAL 1 HOUR")).otherwise(utc)


def calendar_columns(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add date, year, month, day, weekday (Mon=0), weekday_name, ISO week,
    hour, minute, second, interval and season."""
    t = F.col(ts)
    month = F.month(t)
    weekday = F.weekday(t)
    minute = F.minute(t)
    return df.withColumns(
        {
            "date": F.to_date(t),
            "year": F.year(t),
            "month": month,
            "day": F.dayofmonth(t),
            "weekday": weekday,
            "week": F.weekofyear(t),
            "hour": F.hour(t),
            "minute": minute,
            "second": F.second(t),
            "weekday_name": F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), weekday + 1),
            "interval": quarter_hour(minute),
            "season": season_of(month),
        }
    )
