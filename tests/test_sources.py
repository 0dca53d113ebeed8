"""File order, parameters and long prices from files, the tick table as an output."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from strikeflow import schemas
from strikeflow.operators.reports import by_month, duration_report_by_zone
from strikeflow.params import Params, constraint_table, strike_table
from strikeflow.plans.model import DispatchModel
from strikeflow.sources import read_params, read_prices, read_ticks, write_ticks
from strikeflow.sources.fixtures import LOLP_ROWS
from strikeflow.sources.readers import MissingColumnsError
from tests.micro import every, spp_rows_for, tick


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_ties_follow_the_file_order(spark, tmp_path, fmt):
    """Rows of one instant keep the order of the files, however these are split."""
    rows = [("2024-01-10 10:00:00", "N", *[float(i)] * 11) for i in range(4000)]
    names = [f.name for f in schemas.TICK.fields if f.name != "tick_id"]
    for part in range(3):
        df = spark.createDataFrame(rows[part * 1300 : (part + 1) * 1300], names).coalesce(1)
        df.write.mode("append").option("header", "true").option("parquet.block.size", 8192).format(fmt).save(str(tmp_path / f"part{part}"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    seen = []
    try:
        for size in ("128m", "8k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            t = read_ticks(spark, [str(tmp_path / f"part{i}") for i in range(3)], fmt)
            seen.append([(r.tick_id, r.lz_west) for r in t.orderBy("tick_id").collect()])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    prices = [[v for _, v in s] for s in seen]
    assert prices[0] == [float(i) for i in range(3900)] == prices[1]
    assert len({i for i, _ in seen[0]}) == 3900


def test_given_ids_are_kept(spark, tmp_path):
    spark.createDataFrame([tick(7, ts, 1.0) for ts in every("2024-01-10 10:00:00", 5, 2)], schemas.TICK).write.parquet(str(tmp_path / "t"))
    assert {r.tick_id for r in read_ticks(spark, str(tmp_path / "t")).collect()} == {7}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_parameters_from_files(spark, tmp_path, fmt):
    p = Params().with_constraints(weekly_max=25, min_duration=7.5, days=(1, 1, 1, 1, 1, 0, 1))
    p = dataclasses.replace(p, strikes_spp={m: (m + 0.5, m + 1.0, m + 2.0) for m in range(1, 13)})
    write = lambda df, name: df.coalesce(1).write.option("header", "true").format(fmt).save(str(tmp_path / name))
    write(strike_table(spark, p), "strikes")
    write(by_month(constraint_table(spark, p)), "constraints")  # as the report has it
    got = read_params(spark, str(tmp_path / "strikes"), str(tmp_path / "constraints"), fmt)
    assert got == p
    assert read_params(spark, base=p) == p
    write(strike_table(spark, p).filter("month < 12"), "short")
    write(strike_table(spark, p).unionAll(strike_table(spark, p).filter("month = 3")), "twice")
    write(strike_table(spark, p).drop("mid_lmp"), "narrow")
    for bad in ("short", "twice", "narrow"):
        with pytest.raises(MissingColumnsError):
            read_params(spark, str(tmp_path / bad), fmt=fmt)


def test_many_points_in_a_long_table(spark, tmp_path):
    """Prices and settlement keyed by point: each of 60 points as if it were alone in a wide table."""
    stamps = every("2024-01-10 21:30:00", 5, 60)
    points = [f"P{i:02d}" for i in range(60)]
    price = lambda i, k: 150.0 + (i * 37 + k * 11) % 300
    ticks = [tick(k, ts, 0.0) for k, ts in enumerate(stamps)]
    frame = spark.createDataFrame(ticks, schemas.TICK)
    zones = ("hb_north", "lz_north", "lz_houston", "lz_south", "lz_west")
    spark.createDataFrame([(k, ts, name, price(i, k)) for k, ts in enumerate(stamps) for i, name in enumerate(points)], schemas.PRICE).write.parquet(str(tmp_path / "p"))
    one = spp_rows_for(ticks, 90.0)
    settled = spark.createDataFrame(sorted({(*r[:4], name, "LZ", 90.0 + i) for r in one for i, name in enumerate(points)}), schemas.SETTLEMENT)
    lolp = spark.createDataFrame(list(LOLP_ROWS), schemas.LOLP)
    p = Params().with_options(zones=tuple(n.lower() for n in points), points={n: n.lower() for n in points})
    long = DispatchModel(frame.drop(*zones), settled, lolp, p, prices=read_prices(spark, str(tmp_path / "p")))
    value, counts = ({(r.zone, *map(str, r[:])) : r for r in df.collect()} for df in (long.monthly_value(), long.strike_counts()))
    assert len({k[0] for k in value}) == 60 == len({k[0] for k in counts})
    columns = ["scenario", "strike_case", "year", "constrained", "m01"]
    for i in (0, 41):
        wide = spark.createDataFrame([(*t[:3], 0.0, price(i, k), *t[5:]) for k, t in enumerate(ticks)], schemas.TICK)
        alone = DispatchModel(wide, spark.createDataFrame(spp_rows_for(ticks, 90.0 + i), schemas.SETTLEMENT), lolp, Params().with_options(zones=("lz_north",)))
        mine = sorted(tuple(r[c] for c in columns) for r in value.values() if r.zone == points[i].lower())
        assert mine == _rows(alone.monthly_value().select(*columns)) and any(r[-1] for r in mine)


def test_tick_table_and_zone_sheet(spark, tmp_path):
    ticks = [tick(k, ts, 100.0 + (k * 37) % 400) for k, ts in enumerate(every("2024-01-31 21:30:00", 5, 40))]
    make = lambda *a: spark.createDataFrame(*a)
    m = DispatchModel(make(ticks, schemas.TICK), make(spp_rows_for(ticks), schemas.SETTLEMENT), make(list(LOLP_ROWS), schemas.LOLP))
    write_ticks(m.series, str(tmp_path / "ticks"))
    back = spark.read.parquet(str(tmp_path / "ticks"))
    assert back.count() == 40 * 24 and back.select("month").distinct().count() == 2
    keys = ("zone", "scenario", "strike_case", "tick_id", "cduration", "cvalue")
    assert _rows(back.select(*keys)) == _rows(m.series.select(*keys))

    report = m.duration_report("base")
    sheet = duration_report_by_zone(report, m.p)
    assert len(sheet.columns) == 5 + 6 * 4
    for r in sheet.collect():
        filled = [c for c in sheet.columns[5:] if r[c] is not None]
        assert filled and all(c.startswith(f"{r.zone}_") for c in filled)
    assert sheet.count() == report.count()
    assert sheet.filter(F.col("lz_west_dur_low").isNotNull()).count() == report.filter("zone = 'lz_west'").count()


def test_settlement_dates_are_read_as_the_formatter_reads_them(spark):
    """Rearranged and cast, or by the formatter: the same date, and none for what is no date."""
    from strikeflow.operators.settlement import delivery_date

    good = ["01/31/2024", "02/29/2024", "12/01/2025", "06/07/0999", "10/10/2999"]
    found = spark.createDataFrame([(t,) for t in good], "delivery_date string").select("delivery_date", delivery_date().alias("d"))
    assert {r.delivery_date: str(r.d) for r in found.collect()} == {t: f"{t[6:]}-{t[:2]}-{t[3:5]}" for t in good}
    for bad in ("02/30/2024", "13/01/2024", "00/10/2024", "1/2/2024", "01/2 /2024", "01/2T/2024", "2024-01-31", ""):
        with pytest.raises(Exception, match="not a settlement date"):
            spark.createDataFrame([(bad,)], "delivery_date string").select(delivery_date()).collect()


def test_settlement_means_are_of_all_rows_of_a_quarter_hour(spark):
    """Summed under the text of the date first: rows without a price count nothing, points of two types are one mean."""
    from strikeflow.operators import settlement as ST
    from strikeflow.operators import zones as Z
    from strikeflow.params import Params

    p = Params()
    price = lambda date, name, kind, v: (date, 3, 2, "N", name, kind, v)
    rows = [price("01/31/2024", "LZ_NORTH", "LZ", v) for v in (1.0, 2.0, None, 6.0)] + [price("01/31/2024", "LZ_WEST", "LZ", None)]
    rows += [price("01/31/2024", "LZ_NORTH", "LZEW", 100.0), price(None, "LZ_NORTH", "LZ", 9.0)]
    spp = spark.createDataFrame(rows, schemas.SETTLEMENT)
    got = ST.by_chunk(spp, list(p.points), Z.zone_ordinals(spark, p)).collect()
    assert [(r.zone_ord, str(r.date), r.hour, list(r._settled.values())) for r in got] == [(p.zones.index("lz_north"), "2024-01-31", 2, [3.0])]
