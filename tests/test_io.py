"""Readers, sinks and the whole way from files to reports."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strikeflow.params import Params
from strikeflow.plans.model import DispatchModel
from strikeflow.sources import read_lolp, read_settlement, read_ticks, write_reports
from strikeflow.sources.fixtures import LOLP_ROWS, load_fixture
from strikeflow.sources.readers import LOLP_NAMES, SETTLEMENT_NAMES, TICK_NAMES, MissingColumnsError
from tests.conftest import SF_SMALL
from tests.micro import every, spp_rows_for, tick


@pytest.fixture(scope="module")
def frames(spark):
    ticks, spp, lolp = load_fixture(spark, SF_SMALL)
    return ticks.orderBy("tick_id").limit(300), spp, lolp


def _source_names(df, names):
    return df.select(*[F.col(k).alias(v) for k, v in names.items()])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_operator_files_to_reports(spark, frames, tmp_path, fmt):
    ticks, spp, lolp = frames
    stamped = ticks.orderBy("tick_id").withColumn("ts", F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).withColumn("more", F.lit(1))
    writer = lambda df, name: df.coalesce(1).write.option("header", "true").format(fmt).save(str(tmp_path / name))
    writer(_source_names(stamped, TICK_NAMES | {"more": "Unused"}), "ticks")
    writer(_source_names(spp.filter(F.col("delivery_date").endswith("2024")), SETTLEMENT_NAMES), "spp2024")
    writer(_source_names(spp.filter(F.col("delivery_date").endswith("2025")), SETTLEMENT_NAMES), "spp2025")
    writer(_source_names(lolp, LOLP_NAMES), "lolp")

    t = read_ticks(spark, str(tmp_path / "ticks"), fmt)
    assert t.columns == ticks.columns
    drop = [c for c in t.columns if c != "tick_id"]
    assert sorted(map(tuple, t.select(*drop).collect())) == sorted(map(tuple, ticks.select(*drop).collect()))
    s = read_settlement(spark, [str(tmp_path / "spp2024"), str(tmp_path / "spp2025")], fmt)
    assert s.count() == spp.count()
    got = DispatchModel(t, s, read_lolp(spark, str(tmp_path / "lolp"), fmt)).monthly_value().collect()
    want = DispatchModel(*frames).monthly_value().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_missing_columns_raise(spark, frames, tmp_path):
    frames[0].drop("rtorpa", "lz_west").write.parquet(str(tmp_path / "t"))
    with pytest.raises(MissingColumnsError, match="LZ_WEST, RTORPA"):
        read_ticks(spark, str(tmp_path / "t"))
    spark.range(5).write.parquet(str(tmp_path / "u"))
    for read in (read_ticks, read_settlement, read_lolp):
        with pytest.raises(MissingColumnsError):
            read(spark, str(tmp_path / "u"))


def test_column_map(spark, frames, tmp_path):
    frames[0].withColumnRenamed("ts", "when").write.parquet(str(tmp_path / "t"))
    assert read_ticks(spark, str(tmp_path / "t"), columns={"ts": "when"}).count() == 300


def test_bad_timestamp_raises(spark, frames, tmp_path):
    frames[0].limit(3).withColumn("ts", F.lit("yesterday")).write.parquet(str(tmp_path / "t"))
    with pytest.raises(PySparkException, match="not a timestamp"):
        read_ticks(spark, str(tmp_path / "t")).collect()


def test_unparsable_settlement_date_raises(spark):
    from strikeflow import schemas

    ticks = [tick(0, "2024-01-10 10:00:00", 300.0)]
    rows = [("2024-01-10", *r[1:]) for r in spp_rows_for(ticks)]
    m = DispatchModel(spark.createDataFrame(ticks, schemas.TICK), spark.createDataFrame(rows, schemas.SETTLEMENT), spark.createDataFrame(list(LOLP_ROWS), schemas.LOLP))
    with pytest.raises(PySparkException, match="not a settlement date"):
        m.settlement_wide.collect()


NAMES = {
    "value", "value_constrained", "value_new_ordc", "value_new_ordc_constrained", "duration", "duration_new_ordc",
    "strike_counts", "strikes", "constraints",
}


@pytest.fixture(scope="module")
def reports(frames):
    return DispatchModel(*frames).reports()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_nine_reports_written_and_read(spark, reports, tmp_path, fmt):
    assert set(reports) == NAMES
    write_reports(reports, str(tmp_path), fmt)
    for name, df in reports.items():
        back = spark.read.format(fmt).option("header", "true").load(str(tmp_path / name))
        assert back.columns == df.columns
        text = lambda rows: [tuple(None if v is None else str(v).lower() for v in r) for r in rows]
        want = text(df.collect())
        got = text(back.collect())
        assert sorted(got, key=repr) == sorted(want, key=repr)
        parts = sorted(p for p in (tmp_path / name).iterdir() if p.name.startswith("part-"))
        ordered = [r for p in parts for r in text(spark.read.format(fmt).schema(back.schema).option("header", "true").load(str(p)).coalesce(1).collect())]
        assert ordered == want


def test_report_contents(reports):
    assert [r.attribute for r in reports["strikes"].collect()] == ["low_spp", "mid_spp", "high_spp", "low_lmp", "mid_lmp", "high_lmp"]
    low = reports["strikes"].collect()[0]
    assert (low.m01, low.m03, low.m12) == (100.0, 55.0, 100.0)
    constraints = {r.attribute: r.m06 for r in reports["constraints"].collect()}
    assert constraints["daily_max"] == 10 and constraints["w2_start"] == 22 and constraints["sun"] == 1
    assert {r.zone for r in reports["strike_counts"].collect()} == set(Params().zones)
    order = [(r.year, r.case_ord, r.zone_ord) for r in reports["value"].collect()]
    assert order == sorted(order)


def test_strike_zones_can_be_chosen(frames):
    m = DispatchModel(*frames, Params().with_options(zones=("lz_west", "lz_south")))
    assert {r.zone for r in m.strike_counts(("lz_south",)).collect()} == {"lz_south"}
    assert {r.zone for r in m.reports(strike_zones=["lz_west"])["strike_counts"].collect()} == {"lz_west"}


def test_settlement_and_events_in_the_repeated_hour(spark):
    from tests.micro import model

    # 01:00-01:55 twice on 2021-11-07; the strike is on in the second pass only
    first = [tick(100 + i, ts, 30.0) for i, ts in enumerate(every("2021-11-07 01:00:00", 5, 12))]
    second = [tick(i, ts, 300.0 if i >= 3 else 30.0, flag="Y") for i, ts in enumerate(every("2021-11-07 01:00:00", 5, 12))]
    spp = spp_rows_for(first, 40.0) + spp_rows_for(second, 90.0)
    m = model(spark, first + second, spp=spp)
    t = {r.tick_id: r for r in m.enriched_ticks.collect()}
    assert t[100].lz_north_spp == 40.0 and t[0].lz_north_spp == 90.0  # each pass has its own price
    s = {r.tick_id: r for r in m.series.filter("zone = 'lz_north' AND scenario = 'base' AND strike_case = 'low'").collect()}
    assert [s[100 + i].strike for i in range(12)] == [0] * 12
    assert [s[i].strike for i in range(12)] == [0, 0, 0] + [1] * 9
    assert s[3].dispatch == 1 and s[3].event == 1 and s[11].event == 1
    assert s[10].duration == 40.0


def test_stray_flag_does_not_reorder(spark):
    from tests.micro import model

    ticks = [tick(i, ts, 30.0, flag="Y" if i == 1 else "N") for i, ts in enumerate(every("2024-06-10 10:00:00", 5, 4))]
    t = {r.tick_id: r.tick_secs for r in model(spark, ticks).timed_ticks.collect()}
    assert [t[i] for i in range(3)] == [300.0] * 3


def test_one_hot_day_spreads_and_equals_the_plain_form(spark):
    """A day with a third of all ticks splits by zone and hour, and the carries make up for it."""
    from tests.micro import model

    busy = [tick(i, ts, 100.0 + (i * 37) % 400) for i, ts in enumerate(every("2024-01-10 00:00:00", 5, 288))]
    calm = [tick(1000 + i, ts, 100.0 + (i * 53) % 400) for i, ts in enumerate(every("2024-01-11 00:00:00", 60, 24 * 24))]
    m = model(spark, busy + calm, partitions=64)
    hot = m.zone_strikes().filter("date = DATE '2024-01-10'").select(F.spark_partition_id().alias("p"))
    assert hot.select("p").distinct().count() > 24
    weekly = {}
    rows = m.series.orderBy("zone", "scenario", "strike_case", "ord_ts").collect()
    for r in rows:  # the plain running count of a series over its week
        key = (r.zone, r.scenario, r.strike_case, r.week, r.year)
        if r.qualifying and r.daily <= r.daily_max:
            weekly[key] = weekly.get(key, 0) + 1
        assert r.weekly == weekly.get(key)
    assert max(weekly.values()) > 10
