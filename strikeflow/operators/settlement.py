"""Quarter-hour settlement prices (long: one row per point): mean per quarter hour, wide or by zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.params import POINT_TYPES, POINTS

KEYS = ("date", "hour", "interval", "repeated_hour")


def delivery_date() -> Column:
    """The delivery date; a text that is no MM/dd/yyyy date raises when it is read."""
    text = F.col("delivery_date")
    # a plain date is rearranged and cast, at a small part of the formatter's cost; all other texts are the formatter's
    plain = F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 1, 2), F.substring(text, 4, 2)).try_cast("date")
    date = F.when(text.rlike("^[01][0-9]/[0-3][0-9]/[12][0-9]{3}\\z"), plain).otherwise(F.try_to_timestamp(text, F.lit("MM/dd/yyyy")).cast("date"))
    read = F.when(date.isNull(), F.raise_error(F.concat(F.lit("not a settlement date (MM/dd/yyyy): "), text)).cast("date")).otherwise(date)
    # never NULL, and Spark is to know it: a join on it would ask every settlement row, before they are added up, and parse its text for that
    return F.coalesce(read, F.lit("1970-01-01").cast("date"))


def _wanted(spp: DataFrame, points, types) -> DataFrame:
    """Rows of the wanted points and point types with all keys (pushed to the scan)."""
    return spp.filter(
        F.col("point_name").isin(*points)
        & F.col("point_type").isin(*types)
        & F.col("delivery_date").isNotNull()
        & F.col("delivery_hour").isNotNull()
        & F.col("delivery_interval").isNotNull()
        & F.col("repeated_hour").isNotNull()
    )


def _typed_keys(rows: DataFrame, *kept: str) -> DataFrame:
    return rows.select(
        delivery_date().alias("date"),
        (F.col("delivery_hour") - 1).cast("int").alias("hour"),
        F.col("delivery_interval").cast("int").alias("interval"),
        "repeated_hour",
        *kept,
    )


def by_chunk(spp: DataFrame, points, ordinals: DataFrame, types=POINT_TYPES) -> DataFrame:
    """One row per (zone_ord, date, hour): ``_settled``, the mean price by (interval, repeated flag), at most
    eight of them.

    ``ordinals`` (point, zone_ord) has a row per wanted point of ``points``;
    any number of points will do, none of them is a column."""
    # prices are added up by zone under the text of their date, which is parsed once a quarter hour
    rows = _wanted(spp, points, types).join(F.broadcast(ordinals), F.col("point_name") == F.col("point"))
    sums = rows.groupBy("zone_ord", "delivery_date", "delivery_hour", "delivery_interval", "repeated_hour").agg(F.sum("price").alias("price"), F.count("price").alias("prices"))
    means = _typed_keys(sums, "zone_ord", "price", "prices").groupBy("zone_ord", *KEYS).agg(F.try_divide(F.sum("price"), F.sum("prices")).alias("price"))
    return means.filter(F.col("price").isNotNull()).groupBy("zone_ord", "date", "hour").agg(
        F.map_from_entries(F.collect_list(F.struct(F.struct("interval", "repeated_hour"), "price"))).alias("_settled")
    )


def shape_settlement(spp: DataFrame, points: dict = POINTS, types=POINT_TYPES) -> DataFrame:
    """Mean price per (date, hour-beginning, interval, repeated flag) and point.

    Unwanted points/types are filtered before the pivot (pushed to the scan);
    the pivot value list is fixed, so Spark needs no extra distinct pass, and
    the mean is aggregated map-side before the shuffle.  The result has at
    most ~100 rows per calendar day.
    """
    kept = _typed_keys(_wanted(spp, points.keys(), types), "point_name", "price")
    wide = (
        kept.groupBy(*KEYS)
        .pivot("point_name", list(points.keys()))
        .agg(F.avg("price"))
    )
    named = wide.select(*KEYS, *[F.col(src).alias(f"{dst}_spp") for src, dst in points.items()])
    value_cols = [f"{dst}_spp" for dst in points.values()]
    any_value = F.lit(False)
    for c in value_cols:
        any_value = any_value | F.col(c).isNotNull()
    return named.filter(any_value)
