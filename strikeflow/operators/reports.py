"""Report aggregates over the zone table.

``facts`` is one pass over it, without a shuffle: value sums, strike counts and
longest durations of all the zone's series, by hour and event.  All reports are
made from these few rows, so a run writes them once, and facts of earlier dates
can be kept (``plans.incremental``).
Month columns are a fixed list (m01..m12); a (year, month) cell with no ticks
stays NULL, one whose values are all NULL sums to 0.

Value sums are kept as whole numbers (``exact_sums``): they add up to the same
result in any order and partitioning, and partial sums can be stored and added
later.  They do not contain the strike: the value of a month is
``a - strike * b``, so a new last month, whose strike values all earlier ticks
(``strike_basis``), needs no earlier tick.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeflow.functions.rounding import np_round
from strikeflow.operators.dispatch import constrained_event, event, series_rows
from strikeflow.operators.series import named, valuation_strike
from strikeflow.operators.zones import series_of_zone
from strikeflow.params import SCENARIOS, Params

MONTHS = tuple(range(1, 13))
#: Binary places of the whole and of the fine part of a stored sum.
WHOLE, FINE = 20, 32
SUMS = ("a", "b", "ca", "cb")
MONTH_KEYS = ("scen_ord", "zone_ord", "case_ord", "year", "month")


def mcol(m: int) -> str:
    return f"m{m:02d}"


def exact_sums(v: str, name: str) -> list[Column]:
    """Sum of ``v`` as two whole numbers, of its multiples of 2^-20 and of the rest's of 2^-52; nulls count nothing.

    Good for sums up to 2^43 of up to 2^31 rows; what is cut off a row is below 2^-52."""
    scaled = f"(({v}) * {float(1 << WHOLE)!r}D)"
    parts = {"whole": f"floor({scaled})", "fine": f"floor(({scaled} - floor({scaled})) * {float(1 << FINE)!r}D)"}
    return [F.expr(f"coalesce(sum({e}), 0L)").alias(f"{name}_{kind}") for kind, e in parts.items()]


def total(name: str) -> Column:
    """The sum that ``exact_sums`` stored."""
    return (F.col(f"{name}_whole") + F.col(f"{name}_fine") / F.lit(float(1 << FINE))) / F.lit(float(1 << WHOLE))


def facts(z: DataFrame, p: Params) -> DataFrame:
    """Per zone, date, hour and low-case event: one aggregation for all reports, inside the zone table's partitioning.

    A scenario's series are added up by its own low case's events only: those of the base scenario by ``event``, those of
    the new curve by ``new_event`` and ``new_cevent``, unconstrained and constrained; the other scenario's events are NULL
    and its sums 0.  Of the ticks of an hour that share them: their number ``n`` (of the base scenario's rows; 0 in the
    others, so that every tick counts once), and per series its ticks on
    strike, the sums of the captured part of each tick's quarter-hour share, times its price (``a``) and alone
    (``b``), unconstrained and constrained (``ca``, ``cb``), and its longest durations."""
    series = series_of_zone(p)
    base, new = (next(x for x, si, ci in series if (si, ci) == (i, 0)) for i in (0, 1))
    low = {
        "low_event": event(f"strike{base}", f"carry[{base}]."),
        "new_event": event(f"strike{new}", f"carry[{new}]."),
        "new_cevent": constrained_event(f"starts{new}", f"carry[{new}]."),
    }
    keys = ("zone_ord", "date", "hour", *low)
    # an idle tick of a series has no duration and adds nothing; the first series' rows count the ticks
    rows = series_rows(z.withColumns({name: F.expr(e) for name, e in low.items()}), p, [x for x, *_ in series], f"x = {base} OR strike = 1")
    of_base = F.col("x").isin(*[x for x, si, _ in series if si == 0])
    rows = rows.withColumns({name: F.when(of_base if name == "low_event" else ~of_base, F.col(name)) for name in low})
    aggs = [F.count_if(F.col("x") == base).alias("n"), F.sum(F.col("strike").cast("long")).alias("strike")]
    for c in ("", "c"):
        b = f"CASE WHEN spp IS NOT NULL THEN {c}part * 0.25D * weight END"
        aggs += exact_sums(f"{b} * spp", f"{c}a") + exact_sums(b, f"{c}b")
    aggs += [F.max("duration").alias("dur"), F.max("cduration").alias("cdur")]
    long = rows.groupBy(*keys, "x").agg(*aggs)
    # one row a series: side by side by their maximum
    made = [c for c in long.columns if c not in (*keys, "x", "n")]
    placed = {c: c.replace("_", "#_", 1) if "_" in c else f"{c}#" for c in made}

    def of(x: int, c: str) -> Column:
        own = F.max(F.expr(f"CASE WHEN x = {x} THEN {c} END"))
        return own if c in ("dur", "cdur") else F.coalesce(own, F.lit(0).cast("long"))

    beside = [of(x, c).alias(to.replace("#", str(x))) for x, *_ in series for c, to in placed.items()]
    return long.groupBy(*keys).agg(F.max("n").alias("n"), *beside).withColumnRenamed("low_event", "event")


def month_sums(facts: DataFrame, p: Params) -> DataFrame:
    """Per series, year and month: ticks ``n`` and the sums of ``facts``."""
    sums = [f"{s}#_{kind}" for s in SUMS for kind in ("whole", "fine")]
    months = facts.groupBy("zone_ord", F.year("date").alias("year"), F.month("date").alias("month"))
    g = months.agg(F.sum("n").alias("n"), *[F.sum(c.replace("#", str(x))).alias(c.replace("#", str(x))) for c in sums for x, *_ in series_of_zone(p)])
    return _spread(g, ("zone_ord", "year", "month", "n"), p, {c.replace("#", ""): c for c in sums})


def _spread(g: DataFrame, kept: Sequence[str], p: Params, columns: dict[str, str]) -> DataFrame:
    """The columns of a zone's series (# stands for the number) as a row per series."""
    rows = [
        f"named_struct('scen_ord', {si}, 'case_ord', {ci}, " + ", ".join(f"'{name}', {c.replace('#', str(x))}" for name, c in columns.items()) + ")"
        for x, si, ci in series_of_zone(p)
    ]
    return g.select(*kept, F.expr(f"explode(array({', '.join(rows)}))").alias("s")).select(*kept, "s.*")


def monthly_value(facts: DataFrame, p: Params) -> DataFrame:
    """$/MW by (scenario, constrained, zone, strike case, year) x month, rounded to whole dollars (half to even)."""
    sums = month_sums(facts, p).crossJoin(F.broadcast(facts.agg(F.max(F.month("date")).alias("last_month"))))  # one row
    k = F.expr(f"element_at(array({', '.join(valuation_strike(p, ci) for ci in range(len(p.cases)))}), case_ord + 1)")
    worth = [(con, np_round(total(f"{c}a") - k * total(f"{c}b"), 0)) for con, c in ((False, ""), (True, "c"))]
    flavours = F.explode(F.array(*[F.struct(F.lit(con).alias("constrained"), v.alias("v")) for con, v in worth]))
    keys = ("scen_ord", "zone_ord", "case_ord", "year", "constrained")
    r = sums.select(*MONTH_KEYS, flavours.alias("f")).select(*MONTH_KEYS, "f.*")
    r = r.groupBy(*keys).agg(*[F.max(F.when(F.col("month") == m, F.col("v"))).alias(mcol(m)) for m in MONTHS])
    return _names(r, p).select("scenario", "zone", "zone_ord", "strike_case", "case_ord", "year", "constrained", *map(mcol, MONTHS))


def _names(r: DataFrame, p: Params) -> DataFrame:
    given = {"zone": (p.zones, "zone_ord"), "scenario": (SCENARIOS, "scen_ord"), "strike_case": (p.cases, "case_ord")}
    return r.withColumns({name: named(values, F.col(c)) for name, (values, c) in given.items() if c in r.columns})


def sort_value_report(r: DataFrame) -> DataFrame:
    """Report order: year, then strike case low < mid < high, then zone."""
    return r.orderBy("scenario", "constrained", "year", "case_ord", "zone_ord")


def duration_report(facts: DataFrame, p: Params, scenario: str) -> DataFrame:
    """Longest (rounded) duration per day and event, for the strike cases unconstrained and constrained, one row per
    (zone, year, month, day, event).

    Events are numbered by the low case.  For 'base' every column is keyed by the unconstrained low event.  For
    'new_ordc' the constrained columns are keyed by the constrained low event and matched on the ordinal: each fact
    has a row under each numbering and a single aggregate over (day, ordinal) lines them up, keeping ordinals the
    unconstrained low case has a duration for (the left side of the original merge)."""
    number = {p.cases[ci]: x for x, si, ci in series_of_zone(p) if SCENARIOS[si] == scenario}
    dur, cdur = ({f"{d}_{c}": F.col(f"{d}{x}") for c, x in number.items()} for d in ("dur", "cdur"))
    if scenario == "base":
        keyed = facts.select("zone_ord", "date", "event", *[v.alias(k) for k, v in (dur | cdur).items()])
    else:
        none = F.lit(None).cast("double")
        unc = F.struct(F.col("new_event").alias("event"), *[v.alias(k) for k, v in dur.items()], *[none.alias(k) for k in cdur])
        con = F.struct(F.col("new_cevent").alias("event"), *[none.alias(k) for k in dur], *[v.alias(k) for k, v in cdur.items()])
        keyed = facts.select("zone_ord", "date", F.explode(F.array(unc, con)).alias("k")).select("zone_ord", "date", "k.*")
    # rounding keeps the order, so the longest is rounded once
    longest = keyed.filter(F.col("event").isNotNull()).groupBy("zone_ord", "date", "event").agg(*[np_round(F.max(k), 1).alias(k) for k in (*dur, *cdur)])
    return _names(longest.filter(F.col(f"dur_{p.cases[0]}").isNotNull()), p).select(
        "zone", "zone_ord", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
        F.col("event").cast("int").alias("event"), *dur, *cdur,
    )


def duration_report_by_zone(report: DataFrame, p: Params) -> DataFrame:
    """The duration report as a sheet: the zones' frames one below the other, each with columns of its own
    (``{zone}_dur_low`` and so on), which are missing in the others' rows."""
    values = [c for c in report.columns if c.startswith(("dur_", "cdur_"))]
    frames = [
        report.filter(F.col("zone") == z).select("zone", "year", "month", "day", "event", *[F.col(v).alias(f"{z}_{v}") for v in values])
        for z in p.zones
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def strike_sums(z: DataFrame, p: Params) -> DataFrame:
    """Per series, year, month and hour, its ticks on strike: from the sticky flags alone, or added up from ``facts``."""
    counts = [F.sum(F.col(f"strike{x}").cast("long")).alias(f"strike{x}") for x, *_ in series_of_zone(p)]
    g = z.groupBy("zone_ord", F.year("date").alias("year"), F.month("date").alias("month"), "hour").agg(*counts)
    return _spread(g, ("zone_ord", "year", "month", "hour"), p, {"strike": "strike#"})


def strike_counts(sums: DataFrame, p: Params) -> DataFrame:
    """Strike ticks by (scenario, zone, case, year, hour) x month, from one row per series, year, month and hour."""
    keys = ("scen_ord", "zone_ord", "case_ord", "year", "hour")
    r = sums.groupBy(*keys).agg(*[F.max(F.when(F.col("month") == m, F.col("strike"))).alias(mcol(m)) for m in MONTHS])
    return _names(r, p).select("scenario", "zone", "zone_ord", "strike_case", "case_ord", "year", "hour", *map(mcol, MONTHS))


def by_month(table: DataFrame) -> DataFrame:
    """A table of one row per month in report direction: one row per attribute, columns m01..m12."""
    attributes = [c for c in table.columns if c != "month"]
    long = table.select(
        "month",
        F.posexplode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value")) for a in attributes])).alias("ord", "e"),
    )
    cells = [F.max(F.when(F.col("month") == m, F.col("e.value"))).alias(mcol(m)) for m in MONTHS]
    return long.groupBy("ord", F.col("e.attribute").alias("attribute")).agg(*cells).orderBy("ord").drop("ord")
