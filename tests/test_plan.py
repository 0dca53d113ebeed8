"""Plan shape: no Python in the plan, one shuffle of the ticks and one of the zone table, one sort of it,
no table of tick x series rows shuffled or written."""

import re

from pyspark.sql import functions as F

from strikeflow.operators import carries as CA
from strikeflow.operators import reports as R
from strikeflow.operators import settlement as ST
from strikeflow.operators import zones as Z
from strikeflow.params import Params
from strikeflow.plans.model import DispatchModel
from strikeflow.sources.fixtures import load_fixture
from tests.conftest import SF_SMALL

ZONE_EXCHANGE = r"Exchange hashpartitioning\(zone_ord#\d+, date#\w+, hour#\w+, \d+\), REPARTITION"
TICK_EXCHANGE = r"Exchange hashpartitioning\(date#\w+, hour#\w+, \d+\), REPARTITION"
INFERRING = "spark.sql.constraintPropagation.enabled"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _model(spark):
    return DispatchModel.from_fixture(spark, SF_SMALL)


def test_no_python_udfs(spark):
    m = _model(spark)
    for df in (m.scanned(), m.zone_series, m.monthly_value(), m.strike_counts()):
        plan = _plan(df)
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "PythonUDF" not in plan


def test_one_shuffle_of_ticks_and_of_zones(spark):
    plan = _plan(_model(spark).scanned())
    assert len(re.findall(ZONE_EXCHANGE, plan)) == 1 == len(re.findall(TICK_EXCHANGE, plan))


def test_one_sort_serves_all_windows_of_a_quarter(spark):
    plan = _plan(CA.quarters(_model(spark).zone_local(), Params()))
    above = plan[: re.search(ZONE_EXCHANGE, plan).start()]
    assert len(re.findall(r"\bWindow \[", above)) == 3
    assert len(re.findall(r"\bSort \[", above)) == 1
    # reduced where they lie
    assert "Exchange hashpartitioning" not in above and "HashAggregate" in above


def test_facts_are_aggregated_without_a_shuffle(spark):
    m = _model(spark)
    plan = _plan(R.facts(m.zone_series, m.p))
    assert not re.search(r"Exchange hashpartitioning\([^)]*event", plan)


def test_strike_counts_need_no_series(spark):
    """Counted from the flags: a shuffle of the ticks, one of the zones, one of the counts; no settlement prices."""
    plan = _plan(_model(spark).strike_counts())
    assert len(re.findall(ZONE_EXCHANGE, plan)) == 1 == len(re.findall(TICK_EXCHANGE, plan))
    assert "case_ord" not in plan[re.search(ZONE_EXCHANGE, plan).start() :]
    assert "_settled" not in plan and "price_spp" not in plan and "delivery_date" not in plan


def test_written_tables_are_narrow(spark):
    """A run writes the carries, a row per series and quarter hour, and the facts; no ticks."""
    m = _model(spark)
    m.reports()
    import os

    assert sorted(os.listdir(m.staged.root)) == ["carries", "facts"]
    assert "tick_id" not in m.carries.columns + m.facts.columns
    quarters = m.calendar_ticks.select("date", "hour", "interval", "second_pass").distinct().count()
    assert m.carries.count() == quarters * 24
    m.close()
    assert m.staged.root is None


def test_columns_pruned_at_scan(spark):
    plan = _plan(_model(spark).scanned())
    schemas = re.findall(r"ReadSchema: struct<[^>]*>", plan)
    assert schemas
    for s in schemas:
        assert "user_id" not in s and "event_type" not in s


def _scans(df) -> int:
    return len(re.findall(r"FileScan parquet", _plan(df)))


def test_ticks_are_read_twice(spark):
    """Once for the per-hour summary, once for the tick table; nothing else reads them."""
    ticks, spp, lolp = load_fixture(spark, SF_SMALL)
    settled = spark.createDataFrame([], spp.schema)
    assert _scans(DispatchModel(ticks, settled, lolp).scanned()) == 2


def test_summary_hashes_the_raw_ticks(spark):
    plan = _plan(_model(spark).chunk_summary)
    first = plan.rindex("Exchange hashpartitioning(date#")
    assert "SortAggregate" not in plan[first:] and "HashAggregate" in plan[first:]


def test_building_a_model_reads_no_ticks(spark):
    """Only the seasons are looked at before a query runs."""
    ticks, spp, lolp = load_fixture(spark, "/root/testdata/sf0.001")
    broken = ticks.withColumn("ts", F.raise_error(F.lit("read")).cast("timestamp_ntz"))
    DispatchModel(broken, spp, lolp).series_days()


def test_strike_counts_make_the_wanted_zones_only(spark):
    plan = _plan(_model(spark).strike_counts(("lz_west",)))
    generate = [line for line in plan.splitlines() if "Generate explode(" in line and "lmp" in line]
    assert generate and all("lz_west" in line and "lz_south" not in line for line in generate)


def test_strike_counts_are_of_all_zones_by_default(spark):
    counts = _model(spark).strike_counts()
    assert {r.zone for r in counts.select("zone").distinct().collect()} == set(Params().zones)


def test_strike_counts_of_both_ways_agree(spark):
    m = _model(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(m.strike_counts()) == rows(m.reports()["strike_counts"])


def _codegen(spark, df) -> list[str]:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen").split("== Subtree ")[1:]


def test_generated_code_is_small_enough_to_be_compiled(spark):
    """The JVM compiles no method over 8,000 bytes; and a tick's series are rows, in the same generated code as their sums."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = _model(spark)
        parts = _codegen(spark, R.facts(m.zone_series, m.p))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(int(re.search(r"maxMethodCodeSize:(\d+)", part)[1]) for part in parts) < 8000
    assert any("HashAggregate" in part and "Generate explode" in part and "part" in part for part in parts)


def test_settlement_dates_are_not_parsed_for_every_row(spark):
    """A join on the date asks no settlement row whether its date is there, with Spark's default of inferring such filters."""
    inferring, adaptive = (spark.conf.get(c) for c in (INFERRING, "spark.sql.adaptive.enabled"))
    spark.conf.set(INFERRING, "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        m = _model(spark)
        hours = spark.range(4).selectExpr("int(id) AS zone_ord", "date'2024-01-01' + int(id) AS date", "int(id) AS hour").repartition(4, "zone_ord", "date", "hour")
        parts = _codegen(spark, hours.join(ST.by_chunk(m.settlement, list(m.p.points), Z.zone_ordinals(spark, m.p)), ["zone_ord", "date", "hour"], "left"))
    finally:
        spark.conf.set(INFERRING, inferring)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    rows = [part for part in parts if "FileScan" in part and "Exchange hashpartitioning" not in part]
    assert rows and not any("RLIKE" in part for part in rows)
    assert max(int(re.search(r"maxMethodCodeSize:(\d+)", part)[1]) for part in parts) < 8000


def test_carries_join_where_the_ticks_lie(spark):
    """Carries and settlement prices join by hour: the zone table isn't shuffled by quarter hour, nor with its carries."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(_model(spark).series_days(columns=("cvalue",)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    top = plan[: min(m.start() for m in re.finditer(r"\bWindow \[", plan))]
    assert "Exchange" not in top and len(re.findall(r"SortMergeJoin|Join", top)) == 1


def test_facts_of_a_scenario_go_by_its_own_events(spark):
    """Every tick and zone counts once, and idle ticks add nothing: no sum is NULL."""
    m = _model(spark)
    facts = m.facts
    assert facts.agg(F.sum("n")).first()[0] == m.raw_ticks.count() * len(m.p.zones)
    assert facts.filter("event IS NOT NULL AND (new_event IS NOT NULL OR new_cevent IS NOT NULL)").count() == 0
    sums = [c for c in facts.columns if c.startswith(("a", "b", "ca", "cb", "strike"))]
    assert len(sums) == 6 * 9 and facts.filter(" OR ".join(f"{c} IS NULL" for c in sums)).count() == 0


def test_series_and_their_carries_share_the_shuffle_of_zones(spark):
    """The series' rows and the carries need other columns, but the ticks are read, timed, priced and moved once for both."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for columns in (("cvalue",), ("cduration",), None):
            plan = _plan(_model(spark).series_days(columns=columns))
            assert len(re.findall(ZONE_EXCHANGE, plan)) == len(re.findall(r"ReusedExchange [^\n]*REPARTITION_BY_NUM", plan)) + 1 == 2, columns
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
