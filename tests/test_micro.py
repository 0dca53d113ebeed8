"""Hand-made micro-fixtures (FIXTURES.md §3)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strikeflow.operators.enrich import DuplicateSeasonError
from strikeflow.params import Params
from tests.micro import every, model, spp_rows_for, tick


def _series(m, zone="lz_north", scenario="base", case="low"):
    s = m.series.filter((F.col("zone") == zone) & (F.col("scenario") == scenario) & (F.col("strike_case") == case))
    return {r["tick_id"]: r for r in s.collect()}


def test_fall_back_order_and_tick_length(spark):
    # 01:xx twice on 2021-11-07; the second pass gets smaller tick ids on purpose
    first = [tick(100 + i, ts, 30.0) for i, ts in enumerate(every("2021-11-07 00:50:00", 5, 14))]  # 00:50..01:55
    second = [tick(i, ts, 30.0, flag="Y") for i, ts in enumerate(every("2021-11-07 01:00:00", 5, 12))]
    after = [tick(200, datetime(2021, 11, 7, 2, 0), 30.0)]
    m = model(spark, first + second + after)
    t = {r["tick_id"]: r for r in m.timed_ticks.collect()}
    assert t[113]["tick_secs"] == -3300.0  # 01:55 (first pass) -> 01:00 (second pass), local clock
    assert t[11]["tick_secs"] == 300.0  # 01:55 Y -> 02:00
    assert t[0]["prev_hour"] == 1 and not t[0]["day_start"]
    assert t[100]["day_start"]
    # both passes share the (date, hour, interval) quarter hour
    assert t[104]["interval_secs"] == t[0]["interval_secs"]
    assert t[200]["tick_secs"] == 3600.0  # last tick runs to the end of its hour


def test_spring_forward_tick_length(spark):
    ts = [datetime(2021, 3, 14, 1, 50), datetime(2021, 3, 14, 1, 55), datetime(2021, 3, 14, 3, 0), datetime(2021, 3, 14, 3, 5)]
    m = model(spark, [tick(i, x, 30.0) for i, x in enumerate(ts)])
    t = {r["tick_id"]: r["tick_secs"] for r in m.timed_ticks.collect()}
    assert t == {0: 300.0, 1: 3900.0, 2: 300.0, 3: 3300.0}


def test_sticky_strike_within_quarter_hour(spark):
    # low LMP strike in January is 200
    ticks = [tick(0, "2024-01-10 10:00:00", 100.0), tick(1, "2024-01-10 10:05:00", 300.0),
             tick(2, "2024-01-10 10:10:00", 100.0), tick(3, "2024-01-10 10:15:00", 100.0)]
    s = _series(model(spark, ticks))
    assert [s[i]["strike"] for i in range(4)] == [0, 1, 1, 0]
    assert [s[i]["dispatch"] for i in range(4)] == [0, 1, 0, 0]
    assert [s[i]["event"] for i in range(4)] == [None, 1, 1, 1]
    assert [s[i]["duration"] for i in range(4)] == [None, 5.0, 10.0, None]


def test_event_across_midnight_uses_previous_day(spark):
    ticks = [tick(0, "2024-01-10 23:50:00", 100.0), tick(1, "2024-01-10 23:55:00", 300.0),
             tick(2, "2024-01-11 00:00:00", 300.0), tick(3, "2024-01-11 00:05:00", 300.0)]
    s = _series(model(spark, ticks))
    assert s[2]["prev_strike"] == 1 and s[2]["dispatch"] == 0  # carried over midnight
    assert s[2]["event"] == 1 and s[1]["event"] == 1  # new day, new event ordinal
    # tick 1 is the initial tick (capture 0.2), tick 2 is valued in full
    k = 100.0  # last month present is January: low SPP strike 100
    assert s[1]["weight"] == 0.5  # 23:50 and 23:55 share the quarter hour
    assert s[1]["value"] == pytest.approx(0.2 * (50.0 - k) * 0.25 * 0.5)
    assert s[2]["value"] == pytest.approx(1 * (50.0 - k) * 0.25 * s[2]["weight"])


def test_valuation_strike_last_month_vs_row_month(spark):
    ticks = [tick(0, "2024-02-10 10:00:00", 300.0), tick(1, "2024-03-10 10:00:00", 300.0)]
    s_last = _series(model(spark, ticks))
    s_row = _series(model(spark, ticks, params=Params().with_options(strike_basis="row_month")))
    # March (the last month present) low SPP strike is 55; February's is 100
    assert s_last[0]["k_spp"] == 55.0 and s_last[1]["k_spp"] == 55.0
    assert s_row[0]["k_spp"] == 100.0 and s_row[1]["k_spp"] == 55.0


def test_duplicate_lolp_season_raises(spark):
    lolp = [("Winter", "a", "b", 0, 23, 1000.0, 1200.0), ("Winter", "c", "d", 0, 23, 1000.0, 1300.0)]
    with pytest.raises(DuplicateSeasonError):
        model(spark, [tick(0, "2024-01-10 10:00:00", 30.0)], lolp=lolp)


def test_missing_settlement_and_zero_sigma(spark):
    ticks = [tick(0, "2024-01-10 10:00:00", 300.0, rtolcap=5000.0), tick(1, "2024-01-10 10:20:00", 300.0, rtolcap=5000.0)]
    spp = spp_rows_for(ticks, skip={(datetime(2024, 1, 10).date(), 10, 2, "N")})
    lolp = [("Winter", "a", "b", 0, 23, 1000.0, 0.0)]
    m = model(spark, ticks, spp=spp, lolp=lolp)
    t = {r["tick_id"]: r for r in m.priced_ticks.collect()}
    assert t[1]["lz_north_spp"] is None
    assert t[0]["new_rtoffpa"] is None  # sigma 0 -> CDF undefined
    s = _series(m)
    assert s[0]["value"] is not None and s[1]["value"] is None
    assert s[1]["cvalue"] is None or s[1]["cvalue"] == 0.0


def test_window_entry_and_redispatch(spark):
    # window 2 opens at 22:00; strike 22:00-22:10, idle, strike again from 22:30
    prices = [100, 300, 300, 300, 100, 100, 100, 300, 300]
    ticks = [tick(i, ts, float(p)) for i, (ts, p) in enumerate(zip(every("2024-01-10 21:55:00", 5, 9), prices))]
    s = _series(model(spark, ticks))
    assert [s[i]["cdispatch"] for i in range(9)] == [0, 1, 0, 0, 0, 0, 0, 1, 0]
    assert [s[i]["cevent"] for i in range(9)] == [None, 1, 1, 1, 1, 1, 1, 2, 2]
    assert s[3]["cduration_raw"] == 15.0 and s[7]["cduration_raw"] == 5.0
    assert s[0]["cduration"] is None  # 21:55 is outside the windows


def test_idle_ticks_count_in_constrained_duration(spark):
    # Saturday not eligible: no constrained dispatch, so the day's first strike
    # tick opens one constrained event that spans both spells and the idle gap
    prices = [300, 300, 300, 100, 100, 100, 300, 300, 100]
    ticks = [tick(i, ts, float(p)) for i, (ts, p) in enumerate(zip(every("2024-01-13 22:00:00", 5, 9), prices))]
    p = Params().with_constraints(days=(1, 1, 1, 1, 1, 0, 1))
    s = _series(model(spark, ticks, params=p))
    assert all(s[i]["cevent"] == 1 for i in range(9))
    assert s[7]["cduration_raw"] == 40.0
    assert s[4]["cduration_raw"] is None  # idle tick: not a strike


def test_weekday_ineligible_blocks_constrained_dispatch(spark):
    # 2024-01-13 is a Saturday
    ticks = [tick(0, "2024-01-13 22:00:00", 100.0), tick(1, "2024-01-13 22:05:00", 300.0)]
    p = Params().with_constraints(days=(1, 1, 1, 1, 1, 0, 1))
    s = _series(model(spark, ticks, params=p))
    assert s[1]["dispatch"] == 1 and s[1]["cdispatch"] == 0
