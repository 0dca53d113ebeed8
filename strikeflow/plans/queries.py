"""Registered queries: one per operator group of the inventory.

Each takes (spark, sf_dir), derives the market inputs from the shared test
tables (``sources.fixtures``) and returns a DataFrame.  Doubles are rounded
(4 decimals unless the report itself rounds) so that results compare equal
across engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.functions.rounding import np_round
from strikeflow.operators import reports as R
from strikeflow.operators.settlement import delivery_date
from strikeflow.params import ZONES, Params
from strikeflow.plans.incremental import History
from strikeflow.plans.model import DispatchModel
from strikeflow.session import checkpoint_dir
from strikeflow.sources.fixtures import ZONE_FACTORS, load_fixture, prices_from_events, ticks_from_events

SERIES_KEYS = ("zone", "scenario", "strike_case", "tick_id")
SPP_COLS = ("hb_north_spp",) + tuple(f"{z}_spp" for z in ZONES)


def r4(name: str) -> Column:
    return np_round(F.col(name), 4).alias(name)


def _model(spark: SparkSession, sf_dir: str, params: Params | None = None) -> DispatchModel:
    return DispatchModel.from_fixture(spark, sf_dir, params)


def tick_scan(spark, sf_dir):
    t = ticks_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return t.select("tick_id", "ts", "repeated_hour", *[r4(c) for c in t.columns[3:]])


def calendar_columns(spark, sf_dir):
    t = _model(spark, sf_dir).calendar_ticks
    return t.select(
        "tick_id", "date", "year", "month", "day", "weekday", "weekday_name", "week", "hour", "minute",
        F.col("second").cast("int").alias("second"), "interval", "season",
    )


def settlement_pivot(spark, sf_dir):
    s = _model(spark, sf_dir).settlement_wide
    return s.select("date", "hour", "interval", "repeated_hour", *[r4(c) for c in SPP_COLS])


def tick_seconds(spark, sf_dir):
    t = _model(spark, sf_dir).timed_ticks
    return t.select("tick_id", r4("tick_secs"), "day_start", "prev_hour")


def interval_seconds(spark, sf_dir):
    t = _model(spark, sf_dir).timed_ticks
    return t.select("tick_id", r4("interval_secs"), np_round(F.col("weight"), 6).alias("weight"))


def base_price(spark, sf_dir):
    t = _model(spark, sf_dir).priced_ticks
    return t.select("tick_id", *[r4(f"{z}_price") for z in ZONES])


def enriched_ticks(spark, sf_dir):
    t = _model(spark, sf_dir).enriched_ticks
    return t.select(
        "tick_id", "season", "lolp_mu", "lolp_sigma", *[r4(c) for c in SPP_COLS],
        "low_spp", "mid_spp", "high_spp", "low_lmp", "mid_lmp", "high_lmp",
        "daily_max", "weekly_max", "min_duration", "max_duration",
        "w1_start", "w1_end", "w2_start", "w2_end", "weekday_ok",
    )


def normal_cdf(spark, sf_dir):
    from strikeflow.functions.stats import normal_cdf as ncdf

    m = _model(spark, sf_dir)
    mcl = F.lit(m.p.mcl)
    c = F.col
    t = m.enriched_ticks
    return t.select(
        "tick_id",
        np_round(ncdf((c("rtolcap") + c("rtoffcap")) - mcl, c("lolp_mu"), c("lolp_sigma")), 10).alias("off_cdf"),
        np_round(ncdf(c("rtolcap") - mcl, F.lit(0.5) * c("lolp_mu"), F.lit(0.707) * c("lolp_sigma")), 10).alias("on_cdf"),
    )


def new_ordc_adders(spark, sf_dir):
    t = _model(spark, sf_dir).priced_ticks
    return t.select("tick_id", r4("lambda_capped"), r4("new_rtoffpa"), r4("new_rtorpa"))


def new_ordc_price(spark, sf_dir):
    t = _model(spark, sf_dir).priced_ticks
    cols = []
    for z in ZONES:
        cols += [r4(f"new_{z}"), r4(f"new_{z}_price")]
    return t.select("tick_id", *cols)


def new_ordc_settlement(spark, sf_dir):
    t = _model(spark, sf_dir).priced_ticks
    return t.select("tick_id", *[r4(f"new_{z}_spp") for z in ZONES])


def _series_query(*cols, params: Params | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def q(spark, sf_dir):
        s = _model(spark, sf_dir, params).series_days(columns=cols)
        return s.select(*SERIES_KEYS, *[r4(c) if c in _DOUBLES else F.col(c) for c in cols])

    return q


_DOUBLES = {"duration", "event_max_duration", "value", "cduration", "cvalue"}
_P = Params()


def monthly_value(spark, sf_dir):
    r = _model(spark, sf_dir).monthly_value()
    return r.drop("zone_ord", "case_ord")


def strike_counts(spark, sf_dir):
    return _model(spark, sf_dir).strike_counts().drop("zone_ord", "case_ord")


def duration_report_base(spark, sf_dir):
    return _model(spark, sf_dir).duration_report("base").drop("zone_ord")


def duration_report_new_ordc(spark, sf_dir):
    return _model(spark, sf_dir).duration_report("new_ordc").drop("zone_ord")


def duration_report_by_zone(spark, sf_dir):
    m = _model(spark, sf_dir)
    return R.duration_report_by_zone(m.duration_report("base"), m.p)


def monthly_value_long_prices(spark, sf_dir):
    """The monthly value from prices in a long table, keyed by point."""
    ticks, settlement, lolp = load_fixture(spark, sf_dir)
    prices = prices_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    r = DispatchModel(ticks.drop(*ZONE_FACTORS), settlement, lolp, prices=prices).monthly_value()
    return r.drop("zone_ord", "case_ord")


def monthly_value_extended(spark, sf_dir):
    """The monthly value of a history to which the ticks were added in two parts, cut within a date."""
    ticks, settlement, lolp = load_fixture(spark, sf_dir)
    history = History(spark, f"{checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}", lolp)
    cut = F.lit(EXTENDED_AT).cast("timestamp_ntz")
    settled = F.when(F.col("delivery_date").isNotNull(), delivery_date()) <= cut.cast("date")
    history.extend(ticks.filter(F.col("ts") < cut), settlement.filter(settled))
    history.extend(ticks.filter(F.col("ts") >= cut), settlement.filter(~settled))
    r = R.monthly_value(history.facts(), history.p)
    return r.drop("zone_ord", "case_ord")


#: Where the ticks of ``monthly_value_extended`` are cut; settlement prices come with their date's first ticks.
EXTENDED_AT = "2024-07-30 12:10:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tick_scan": tick_scan,
    "calendar_columns": calendar_columns,
    "settlement_pivot": settlement_pivot,
    "tick_seconds": tick_seconds,
    "interval_seconds": interval_seconds,
    "base_price": base_price,
    "enriched_ticks": enriched_ticks,
    "normal_cdf": normal_cdf,
    "new_ordc_adders": new_ordc_adders,
    "new_ordc_price": new_ordc_price,
    "new_ordc_settlement": new_ordc_settlement,
    "strike_flags": _series_query("strike"),
    "dispatch_starts": _series_query("dispatch", "prev_strike"),
    "daily_events": _series_query("event"),
    "event_durations": _series_query("duration", "event_max_duration"),
    "tick_value_last_month": _series_query("value"),
    "tick_value_row_month": _series_query("value", params=_P.with_options(strike_basis="row_month")),
    "constrained_dispatch": _series_query("cdispatch"),
    "constrained_dispatch_outside": _series_query("cdispatch", params=_P.with_options(dispatch_outside=True)),
    "constrained_dispatch_boundary": _series_query("cdispatch", params=_P.with_options(window_entry="boundary")),
    "constrained_dispatch_weekdays": _series_query(
        "cdispatch", "cevent", params=_P.with_constraints(days=(1, 1, 1, 1, 0, 0, 1))
    ),
    "constrained_events": _series_query("cmarker", "cevent", "qualifying"),
    "event_caps": _series_query("daily", "weekly"),
    "event_caps_weekly25": _series_query("daily", "weekly", params=_P.with_constraints(weekly_max=25)),
    "constrained_durations": _series_query("cduration"),
    "constrained_durations_outside": _series_query("cduration", params=_P.with_options(dispatch_outside=True)),
    "constrained_durations_weekly25": _series_query("cduration", params=_P.with_constraints(weekly_max=25)),
    "constrained_durations_max30": _series_query("cduration", params=_P.with_constraints(max_duration=30.0)),
    "constrained_value": _series_query("cvalue"),
    "monthly_value": monthly_value,
    "strike_counts": strike_counts,
    "duration_report_base": duration_report_base,
    "duration_report_new_ordc": duration_report_new_ordc,
    "duration_report_by_zone": duration_report_by_zone,
    "monthly_value_long_prices": monthly_value_long_prices,
    "monthly_value_extended": monthly_value_extended,
}
