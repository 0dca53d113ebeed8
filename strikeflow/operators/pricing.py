"""Tick prices: published adders, and re-pricing under the new reserve curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeflow.functions.stats import standardized, std_normal_cdf
from strikeflow.params import Params


def with_base_price(ticks: DataFrame, zones) -> DataFrame:
    """{zone}_price = zone LMP + on-line reserve adder + reliability adder."""
    return ticks.withColumns(
        {f"{z}_price": F.col(z) + F.col("rtorpa") + F.col("rtordpa") for z in zones}
    )


def with_new_adders(ticks: DataFrame, p: Params) -> DataFrame:
    """Re-priced adders (capped lambda, normal-CDF reserve terms); they are the same for all zones."""
    lam = F.col("system_lambda")
    lam_c = F.when(lam > F.lit(p.lambda_cap), F.lit(p.lambda_cap)).otherwise(lam)
    olcap, offcap = F.col("rtolcap"), F.col("rtoffcap")
    mu, sigma = F.col("lolp_mu"), F.col("lolp_sigma")
    voll, mcl = F.lit(p.voll), F.lit(p.mcl)
    headroom = voll - lam_c

    # columns of their own, so that each is worked out once
    ticks = ticks.withColumns(
        {
            "_off_x": standardized((olcap + offcap) - mcl, mu, sigma),
            "_on_x": standardized(olcap - mcl, F.lit(0.5) * mu, F.lit(0.707) * sigma),
        }
    )
    off_scarcity = F.when(
        (olcap + F.when(olcap <= mcl, F.lit(0.0)).otherwise(offcap)) <= mcl, F.lit(1.0)
    ).otherwise(F.lit(1.0) - std_normal_cdf(F.col("_off_x")))
    on_scarcity = F.when(olcap <= mcl, F.lit(1.0)).otherwise(
        F.lit(1.0) - std_normal_cdf(F.col("_on_x"))
    )
    out = ticks.withColumns(
        {
            "lambda_capped": lam_c,
            "new_rtoffpa": F.when(headroom > 0, F.lit(0.5) * headroom).otherwise(F.lit(0.0)) * off_scarcity,
        }
    )
    return out.withColumn(
        "new_rtorpa",
        F.col("new_rtoffpa")
        + F.lit(0.5) * F.when(headroom > 0, headroom).otherwise(F.lit(0.0)) * on_scarcity,
    ).drop("_off_x", "_on_x")


def with_new_ordc(ticks: DataFrame, p: Params, zones) -> DataFrame:
    """Re-priced adders, and zone prices as columns."""
    out = with_new_adders(ticks, p)
    shift = F.col("system_lambda") - F.col("lambda_capped")
    out = out.withColumns({f"new_{z}": F.col(z) - shift for z in zones})
    return out.withColumns({f"new_{z}_price": F.col(f"new_{z}") + F.col("new_rtorpa") for z in zones})


def with_new_ordc_spp(ticks: DataFrame, zones) -> DataFrame:
    """Time-weighted quarter-hour price under the new curve, on every tick of
    the quarter hour (an all-NULL quarter hour sums to 0)."""
    w = Window.partitionBy("date", "hour", "interval")
    return ticks.withColumns(
        {
            f"new_{z}_spp": F.coalesce(
                F.sum(F.col(f"new_{z}_price") * F.col("weight")).over(w), F.lit(0.0)
            )
            for z in zones
        }
    )
