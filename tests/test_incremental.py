"""Reports extended part by part equal those of one run over all data."""

import pytest
from pyspark.sql import functions as F

from strikeflow.params import Params
from strikeflow.plans.incremental import History, LateTicksError, OtherParametersError
from strikeflow.plans.model import DispatchModel
from strikeflow.sources import publish_reports, published_report, remove_unpublished
from strikeflow.sources.fixtures import load_fixture
from tests.conftest import SF_SMALL



def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def frames(spark):
    ticks, spp, lolp = load_fixture(spark, SF_SMALL)
    dates = [r.d for r in ticks.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    return ticks.cache(), spp.cache(), lolp, dates


def _parts(ticks, spp, edges):
    """Ticks between successive edges, with the settlement prices of the dates they touch."""
    settled = F.to_date("delivery_date", "MM/dd/yyyy")
    bounds = [None, *edges, None]
    for low, high in zip(bounds, bounds[1:]):
        t, s = ticks, spp
        if low:
            t, s = t.filter(F.col("ts") >= F.lit(low).cast("timestamp_ntz")), s.filter(settled > F.lit(low).cast("date"))
        if high:
            t, s = t.filter(F.col("ts") < F.lit(high).cast("timestamp_ntz")), s.filter(settled <= F.lit(high).cast("date"))
        yield t, s


@pytest.mark.parametrize("basis", ["last_month"])
def test_parts_equal_one_run(spark, frames, tmp_path, basis):
    ticks, spp, lolp, dates = frames
    p = Params().with_options(strike_basis=basis).with_constraints(weekly_max=3, daily_max=2)
    # in the middle of a date and of its week; at a date's start; with an empty part
    edges = [f"{dates[len(dates) // 3]} 11:07:00", f"{dates[len(dates) // 2]} 00:00:00", f"{dates[len(dates) // 2]} 00:00:00", f"{dates[-2]} 23:59:00"]
    history = History(spark, str(tmp_path / "h"), lolp, p)
    for t, s in _parts(ticks, spp, edges):
        history.extend(t, s)
    want = DispatchModel(ticks, spp, lolp, p).reports()
    again = History(spark, str(tmp_path / "h"), lolp, p)  # nothing is kept in the object
    got = again.reports()
    for name, df in want.items():
        assert _rows(got[name]) == _rows(df), name
    assert len(again.manifests.numbers()) == len(edges)  # the empty part changed nothing

    early = ticks.filter(F.to_date("ts") == F.lit(dates[0]))
    with pytest.raises(LateTicksError):
        again.extend(early, spp)
    with pytest.raises(OtherParametersError):
        History(spark, str(tmp_path / "h"), lolp, p.with_options(capture_pct=0.5)).reports()
    # the valuation strikes may change: facts do not hold them
    other = p.with_options(strike_basis="row_month")
    revalued = History(spark, str(tmp_path / "h"), lolp, other).reports()["value"]
    assert _rows(revalued) == _rows(DispatchModel(ticks, spp, lolp, other).reports()["value"])


def test_publishing_by_year(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = lambda *rows: spark.createDataFrame(list(rows), "year int, v string")
    small = spark.createDataFrame([("a", 1.0)], "attribute string, m01 double")
    publish_reports({"value": frame((2024, "a"), (2025, "b")), "strikes": small}, out)
    publish_reports({"value": frame((2025, "c"), (2026, "d"))}, out)
    assert _rows(published_report(spark, out, "value")) == [(2024, "a"), (2025, "c"), (2026, "d")]
    assert _rows(published_report(spark, out, "value", years=[2025])) == [(2025, "c")]
    assert _rows(published_report(spark, out, "value", number=1)) == [(2024, "a"), (2025, "b")]
    assert _rows(published_report(spark, out, "strikes")) == [("a", 1.0)]
    with pytest.raises(FileNotFoundError):
        published_report(spark, out, "duration")


def test_a_lost_run_leaves_the_old_reports(spark, tmp_path):
    out = str(tmp_path / "out")
    old = spark.createDataFrame([(2024, "a")], "year int, v string")
    publish_reports({"value": old, "counts": old}, out)
    lost = old.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        publish_reports({"value": old.withColumn("v", F.lit("b")), "counts": lost}, out)
    assert _rows(published_report(spark, out, "value")) == [(2024, "a")] == _rows(published_report(spark, out, "counts"))
    assert len(remove_unpublished(spark, out)) == 1
    assert _rows(published_report(spark, out, "value")) == [(2024, "a")]


def test_two_writers(spark, tmp_path):
    from strikeflow.sources.manifest import ConcurrentWriteError, Manifests

    m = Manifests(spark, str(tmp_path))
    assert m.read() == (0, None)
    assert m.publish(0, {"a": 1}) == 1
    with pytest.raises(ConcurrentWriteError):
        m.publish(0, {"a": 2})
    assert m.read() == (1, {"a": 1})
