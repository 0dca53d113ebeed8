"""Rounding with numpy's rule: scale by 10**d, round half to even, unscale.

Spark's ``round``/``bround`` round the exact binary value instead, which
differs on values like 210.54999999999998 (numpy: 210.6).  Adding 0.0 turns
-0.0 into 0.0.  ``rint`` gives what ``bround`` does at no places, without a
decimal number for each value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def np_round(c: Column, decimals: int = 0) -> Column:
    if decimals == 0:
        return F.rint(c) + F.lit(0.0)
    s = float(10 ** decimals)
    return F.rint(c * F.lit(s)) / F.lit(s) + F.lit(0.0)
