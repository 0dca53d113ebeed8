import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeflow.functions.hours import in_windows, late_outside, outside_windows
from strikeflow.functions.rounding import np_round
from strikeflow.functions.stats import normal_cdf, std_normal_cdf


def test_std_normal_cdf_accuracy(spark):
    xs = [i / 8.0 for i in range(-12 * 8, 12 * 8 + 1)] + [-40.0, 40.0, 7.07, 7.08]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r["x"]: r["p"] for r in df.select("x", std_normal_cdf(F.col("x")).alias("p")).collect()}
    for x in xs:
        want = 0.5 * math.erfc(-x / math.sqrt(2.0))
        assert abs(got[x] - want) <= 1e-14, (x, got[x], want)


def test_normal_cdf_null_and_degenerate(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0), (1.0, 0.0, 0.0), (None, 0.0, 1.0), (1.0, 0.0, -1.0)], "x double, m double, s double")
    out = [r["p"] for r in df.select(normal_cdf(F.col("x"), F.col("m"), F.col("s")).alias("p")).collect()]
    assert abs(out[0] - 0.8413447460685429) < 1e-14
    assert out[1] is None and out[2] is None and out[3] is None


@pytest.mark.parametrize("d", [0, 1, 4])
def test_np_round_matches_numpy(spark, d):
    vals = [0.15, 0.25, 2.5, 3.5, -2.5, 210.54999999999998, 12.25, 105.02625, 0.05, -0.0, 1.45, 7.000000000000001]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["r"] for r in df.select(np_round(F.col("v"), d).alias("r")).collect()]
    want = [float(np.round(v, d)) + 0.0 for v in vals]
    assert got == want
    assert all(math.copysign(1.0, g) == 1.0 or g != 0.0 for g in got)  # no negative zero


def test_window_predicates_overlap(spark):
    # windows [0,10) and [5,8): hour 8 is inside window 1 and also "outside"
    rows = [(h, 0, 10, 5, 8) for h in range(0, 12)]
    df = spark.createDataFrame(rows, "hour int, w1_start int, w1_end int, w2_start int, w2_end int")
    out = {
        r["hour"]: (r["i"], r["o"], r["l"])
        for r in df.select(
            "hour",
            in_windows(F.col("hour")).alias("i"),
            outside_windows(F.col("hour")).alias("o"),
            late_outside(F.col("hour")).alias("l"),
        ).collect()
    }
    assert out[3] == (True, False, False)
    assert out[8] == (True, True, True)
    assert out[11] == (False, True, True)
    # not-outside always implies inside
    assert all(i for i, o, _ in out.values() if not o)
