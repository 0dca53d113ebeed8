"""Invariants of the series table on the smallest shared fixture."""

import pytest
from pyspark.sql import functions as F

from strikeflow.plans.model import DispatchModel
from strikeflow.sources.fixtures import load_fixture
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def series(spark):
    return DispatchModel.from_fixture(spark, SF_SMALL).series.cache()


def test_strike_monotone_in_case(series):
    w = series.groupBy("zone", "scenario", "tick_id").pivot("strike_case", ["low", "mid", "high"]).agg(F.max("strike"))
    assert w.filter((F.col("low") < F.col("mid")) | (F.col("mid") < F.col("high"))).count() == 0


def test_constrained_dispatch_only_on_strike(series):
    assert series.filter((F.col("cdispatch") == 1) & (F.col("strike") == 0)).count() == 0
    assert series.filter((F.col("dispatch") == 1) & (F.col("strike") == 0)).count() == 0


def test_constrained_duration_bounded(series):
    assert series.filter(F.col("inside") & (F.col("cduration") > F.col("max_duration"))).count() == 0
    assert series.filter(~F.col("inside") & F.col("cduration").isNotNull()).count() == 0


def test_interval_seconds_is_sum_of_tick_seconds(spark):
    t = DispatchModel.from_fixture(spark, SF_SMALL).timed_ticks
    g = t.groupBy("date", "hour", "interval").agg(F.sum("tick_secs").alias("s"), F.first("interval_secs").alias("i"))
    assert g.filter(F.abs(F.col("s") - F.col("i")) > 1e-9).count() == 0


def test_result_independent_of_input_partitioning(spark):
    ticks, spp, lolp = load_fixture(spark, SF_SMALL)
    a = DispatchModel(ticks, spp, lolp).monthly_value()
    b = DispatchModel(ticks.repartition(7, "value" if "value" in ticks.columns else "tick_id").orderBy(F.rand(3)), spp.repartition(5), lolp).monthly_value()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
