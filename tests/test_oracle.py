"""Registered queries against their DuckDB oracles on the smallest fixture."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from strikeflow.plans.queries import QUERIES
from tests.conftest import SF_SMALL

KEYS = [
    "settlement_pivot", "tick_seconds", "normal_cdf", "new_ordc_settlement", "dispatch_starts",
    "event_caps_weekly25", "constrained_durations_outside", "constrained_value",
    "monthly_value", "duration_report_new_ordc", "strike_counts", "monthly_value_long_prices", "duration_report_by_zone",
]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    return c


def test_every_query_has_an_oracle():
    own = set(QUERIES)
    assert own <= set(E.queries()) and own <= set(E.oracle_sql())


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert "m01" in df.columns and df.count() > 0
