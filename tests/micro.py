"""Helpers to build hand-made tick / settlement / LOLP frames."""

from __future__ import annotations

from datetime import datetime, timedelta

from strikeflow import schemas
from strikeflow.plans.model import DispatchModel
from strikeflow.sources.fixtures import LOLP_ROWS


def tick(tick_id, ts, price, flag="N", lam=20.0, rtorpa=0.0, rtordpa=0.0, rtolcap=2500.0, rtoffcap=0.0):
    """One tick with the same LMP in every zone."""
    if isinstance(ts, str):
        ts = datetime.fromisoformat(ts)
    return (tick_id, ts, flag, price, price, price, price, price, lam, rtorpa, 0.0, rtordpa, rtolcap, rtoffcap)


def spp_rows_for(ticks, price=50.0, skip=()):
    """One settlement row per tick's quarter hour and point (HE hours)."""
    seen = set()
    out = []
    for t in ticks:
        ts, flag = t[1], t[2]
        key = (ts.date(), ts.hour, ts.minute // 15 + 1, flag)
        if key in seen or key in skip:
            continue
        seen.add(key)
        for name in ("HB_NORTH", "LZ_NORTH", "LZ_HOUSTON", "LZ_SOUTH", "LZ_WEST"):
            typ = "HU" if name.startswith("HB") else "LZ"
            out.append((ts.strftime("%m/%d/%Y"), ts.hour + 1, ts.minute // 15 + 1, flag, name, typ, price))
    return out


def model(spark, ticks, spp=None, lolp=LOLP_ROWS, params=None, **kw):
    t = spark.createDataFrame(ticks, schemas.TICK)
    s = spark.createDataFrame(spp if spp is not None else spp_rows_for(ticks), schemas.SETTLEMENT)
    l = spark.createDataFrame(list(lolp), schemas.LOLP)
    return DispatchModel(t, s, l, params, **kw)


def every(start: str, minutes: int, n: int):
    t0 = datetime.fromisoformat(start)
    return [t0 + timedelta(minutes=minutes * i) for i in range(n)]
