"""Independent DuckDB formulations of every registered query.

Written as the plain whole-series form: every ordered window runs over an
entire series (``lag`` across midnight, weekly running counts over the whole
(ISO week, calendar year) group), ordered by (ts, tick_id).  The Spark plans
split the same computations per series-day with carries, so agreement checks
that decomposition.  The input derivation follows FIXTURES.md §2.
"""

from __future__ import annotations

# Fixed values shared with the fixture derivation and the parameters.
ZONE_FACTORS = (("hb_north", "1.05e0"), ("lz_north", "1.00e0"), ("lz_houston", "1.10e0"),
                ("lz_south", "0.90e0"), ("lz_west", "1.25e0"))
POINTS = (("HB_NORTH", "HU", "1.05e0"), ("LZ_NORTH", "LZ", "1.00e0"), ("LZ_HOUSTON", "LZ", "1.10e0"),
          ("LZ_SOUTH", "LZ", "0.90e0"), ("LZ_WEST", "LZ", "1.25e0"), ("LZ_NORTH", "LZEW", "3.00e0"),
          ("LZ_OTHER", "LZ", "0.50e0"))
ZONES = ("lz_north", "lz_houston", "lz_south", "lz_west")
STRIKES = """(VALUES
 (1, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0), (2, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0),
 (3, 55e0, 80e0, 110e0, 140e0, 200e0, 300e0), (4, 55e0, 80e0, 110e0, 140e0, 200e0, 300e0),
 (5, 55e0, 80e0, 110e0, 140e0, 200e0, 300e0), (6, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0),
 (7, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0), (8, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0),
 (9, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0), (10, 55e0, 80e0, 110e0, 140e0, 200e0, 300e0),
 (11, 55e0, 80e0, 110e0, 140e0, 200e0, 300e0), (12, 100e0, 150e0, 200e0, 200e0, 400e0, 550e0)
) AS s(month, low_spp, mid_spp, high_spp, low_lmp, mid_lmp, high_lmp)"""
LOLP = """(VALUES
 ('Winter', '12/01/2023', 1000e0, 1200e0), ('Winter', '12/01/2024', 1000e0, 1200e0),
 ('Spring', '03/01/2024', 900e0, 1100e0), ('Spring', '03/01/2025', 900e0, 1100e0),
 ('Summer', '06/01/2024', 1100e0, 1300e0), ('Summer', '06/01/2025', 1100e0, 1300e0),
 ('Fall', '09/01/2024', 950e0, 1150e0), ('Fall', '09/01/2025', 950e0, 1150e0)
) AS l(season, start_date, lolp_mu, lolp_sigma)"""

SER = "zone, scenario, strike_case"
# instant order: of the repeated hour, the second pass comes after the first
ORD = "date_trunc('hour', ts), repeated_hour = 'Y', ts, tick_id"


def _constraints(daily_max=10, weekly_max=100, min_duration=11, max_duration=360,
                 windows=(0, 5, 22, 24), days=(1, 1, 1, 1, 1, 1, 1)) -> str:
    rows = ", ".join(
        f"({m}, {daily_max}, {weekly_max}, {float(min_duration)!r}e0, {float(max_duration)!r}e0, "
        + ", ".join(str(w) for w in windows) + ", " + ", ".join(str(d) for d in days) + ")"
        for m in range(1, 13)
    )
    return (f"(VALUES {rows}) AS c(month, daily_max, weekly_max, min_duration, max_duration, "
            "w1_start, w1_end, w2_start, w2_end, mon, tue, wed, thu, fri, sat, sun)")


def _phi(x: str) -> str:
    """Standard normal CDF (Hart 1968 / West 2005 rational form)."""
    z = f"abs({x})"
    num = "0.0352624965998911e0"
    for c in ("0.700383064443688e0", "6.37396220353165e0", "33.912866078383e0",
              "112.079291497871e0", "221.213596169931e0", "220.206867912376e0"):
        num = f"({num} * {z} + {c})"
    den = "0.0883883476483184e0"
    for c in ("1.75566716318264e0", "16.064177579207e0", "86.7807322029461e0", "296.564248779674e0",
              "637.333633378831e0", "793.826512519948e0", "440.413735824752e0"):
        den = f"({den} * {z} + {c})"
    cont = f"({z} + 0.65e0)"
    for k in ("4e0", "3e0", "2e0", "1e0"):
        cont = f"({z} + {k} / {cont})"
    e = f"exp(-({z} * {z}) / 2e0)"
    tail = (f"(CASE WHEN {z} < 7.07106781186547e0 THEN {e} * {num} / {den} "
            f"WHEN {z} <= 37e0 THEN {e} / {cont} / 2.506628274631e0 WHEN {z} > 37e0 THEN 0e0 END)")
    return f"(CASE WHEN ({x}) > 0e0 THEN 1e0 - {tail} ELSE {tail} END)"


def _ncdf(x: str, mu: str, sigma: str) -> str:
    return f"(CASE WHEN {sigma} > 0e0 THEN {_phi(f'(({x}) - ({mu})) / ({sigma})')} END)"


def base_ctes() -> str:
    """Ticks, settlement, enrichment and tick-level pricing."""
    zone_cols = ", ".join(f"(2e0 * v) * {f} AS {z}" for z, f in ZONE_FACTORS)
    pts = ", ".join(f"('{n}', '{t}', {f})" for n, t, f in POINTS)
    spp_cols = ", ".join(
        f"avg(price) FILTER (WHERE point_name = '{n}') AS {n.lower()}_spp"
        for n in ("HB_NORTH", "LZ_NORTH", "LZ_HOUSTON", "LZ_SOUTH", "LZ_WEST")
    )
    spp_any = " OR ".join(f"{n}_spp IS NOT NULL" for n in ("hb_north",) + ZONES)
    price_cols = ", ".join(f"({z} + rtorpa) + rtordpa AS {z}_price" for z in ZONES)
    headroom = "(5000e0 - lambda_capped)"
    off_sc = (f"(CASE WHEN (rtolcap + CASE WHEN rtolcap <= 3000e0 THEN 0e0 ELSE rtoffcap END) <= 3000e0 "
              f"THEN 1e0 ELSE 1e0 - {_ncdf('(rtolcap + rtoffcap) - 3000e0', 'lolp_mu', 'lolp_sigma')} END)")
    on_sc = (f"(CASE WHEN rtolcap <= 3000e0 THEN 1e0 ELSE 1e0 - "
             f"{_ncdf('rtolcap - 3000e0', '0.5e0 * lolp_mu', '0.707e0 * lolp_sigma')} END)")
    new_z = ", ".join(f"{z} - (system_lambda - lambda_capped) AS new_{z}" for z in ZONES)
    new_p = ", ".join(f"new_{z} + new_rtorpa AS new_{z}_price" for z in ZONES)
    new_spp = ", ".join(
        f"coalesce(sum(new_{z}_price * weight) OVER (PARTITION BY date, hour, \"interval\"), 0e0) AS new_{z}_spp"
        for z in ZONES
    )
    return f"""
ev AS (
  SELECT event_id, value AS v, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(date_trunc('second', ts) AS TIMESTAMP)
           + to_days(CAST(floor((dayofmonth(ts) - 1) / 3) * 70
                          + CASE WHEN floor((dayofmonth(ts) - 1) / 3) = 4 THEN 14 ELSE 0 END AS INTEGER)) AS t
  FROM events
),
flagged AS (
  SELECT *, CASE WHEN date_trunc('hour', t) = TIMESTAMP '2024-11-03 01:00:00' AND k % 2 = 1 THEN 'Y' ELSE 'N' END AS pass FROM ev
),
raw_ticks AS (
  SELECT event_id AS tick_id, t AS ts, pass AS repeated_hour, {zone_cols},
         40e0 * v AS system_lambda, k / 10e0 AS rtorpa, k / 20e0 AS rtoffpa, (k % 7) / 10e0 AS rtordpa,
         2500e0 + 150e0 * k AS rtolcap, 10e0 * k AS rtoffcap
  FROM flagged
),
cal AS (
  SELECT *, CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
         CAST(day(ts) AS INTEGER) AS day, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
         CAST(weekofyear(ts) AS INTEGER) AS week, CAST(hour(ts) AS INTEGER) AS hour,
         CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second,
         CASE WHEN minute(ts) < 15 THEN 1 WHEN minute(ts) < 30 THEN 2 WHEN minute(ts) < 45 THEN 3 ELSE 4 END AS "interval",
         CASE WHEN month(ts) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(ts) BETWEEN 6 AND 8 THEN 'Summer'
              WHEN month(ts) BETWEEN 9 AND 11 THEN 'Fall' ELSE 'Winter' END AS season
  FROM raw_ticks
),
timed0 AS (
  SELECT *,
    CASE WHEN lead(ts) OVER (ORDER BY {ORD}) IS NULL THEN (60e0 - minute) * 60e0
         ELSE (epoch_us(lead(ts) OVER (ORDER BY {ORD})) - epoch_us(ts)) / 1e6 END AS tick_secs,
    (lag(date) OVER (ORDER BY {ORD})) IS DISTINCT FROM date AS day_start,
    lag(hour) OVER (ORDER BY {ORD}) AS prev_hour
  FROM cal
),
timed AS (
  SELECT *, CASE WHEN interval_secs <> 0 THEN tick_secs / interval_secs END AS weight
  FROM (SELECT *, sum(tick_secs) OVER (PARTITION BY date, hour, "interval") AS interval_secs FROM timed0)
),
spp_rows AS (
  SELECT strftime(t, '%m/%d/%Y') AS delivery_date, hour(t) + 1 AS delivery_hour,
         CASE WHEN minute(t) < 15 THEN 1 WHEN minute(t) < 30 THEN 2 WHEN minute(t) < 45 THEN 3 ELSE 4 END AS delivery_interval,
         pass AS repeated_hour, p.point_name, p.point_type, (2.5e0 * v) * p.f AS price
  FROM flagged, (VALUES {pts}) AS p(point_name, point_type, f)
  WHERE (hour(t) * 4 + CASE WHEN minute(t) < 15 THEN 1 WHEN minute(t) < 30 THEN 2 WHEN minute(t) < 45 THEN 3 ELSE 4 END) % 29 <> 0
),
spp AS (
  SELECT * FROM (
    SELECT CAST(strptime(delivery_date, '%m/%d/%Y') AS DATE) AS date, CAST(delivery_hour - 1 AS INTEGER) AS hour,
           CAST(delivery_interval AS INTEGER) AS "interval", repeated_hour, {spp_cols}
    FROM spp_rows
    WHERE point_name IN ('HB_NORTH', 'LZ_NORTH', 'LZ_HOUSTON', 'LZ_SOUTH', 'LZ_WEST') AND point_type IN ('HU', 'LZ', '')
    GROUP BY 1, 2, 3, 4)
  WHERE {spp_any}
),
lolp AS (SELECT DISTINCT season, lolp_mu, lolp_sigma FROM {LOLP}),
strikes AS (SELECT * FROM {STRIKES}),
enriched AS (
  SELECT t.*, spp.hb_north_spp, spp.lz_north_spp, spp.lz_houston_spp, spp.lz_south_spp, spp.lz_west_spp,
         lolp.lolp_mu, lolp.lolp_sigma,
         strikes.low_spp, strikes.mid_spp, strikes.high_spp, strikes.low_lmp, strikes.mid_lmp, strikes.high_lmp,
         c.daily_max, c.weekly_max, c.min_duration, c.max_duration, c.w1_start, c.w1_end, c.w2_start, c.w2_end,
         list_extract([c.mon, c.tue, c.wed, c.thu, c.fri, c.sat, c.sun], t.weekday + 1) AS weekday_ok
  FROM timed t
  LEFT JOIN spp ON t.date = spp.date AND t.hour = spp.hour AND t."interval" = spp."interval" AND t.repeated_hour = spp.repeated_hour
  LEFT JOIN lolp ON t.season = lolp.season
  LEFT JOIN strikes ON t.month = strikes.month
  LEFT JOIN constr c ON t.month = c.month
),
priced0 AS (
  SELECT *, {price_cols},
         CASE WHEN system_lambda > 5001e0 THEN 5001e0 ELSE system_lambda END AS lambda_capped
  FROM enriched
),
priced1 AS (
  SELECT *, (CASE WHEN {headroom} > 0 THEN 0.5e0 * {headroom} ELSE 0e0 END) * {off_sc} AS new_rtoffpa FROM priced0
),
priced2 AS (
  SELECT *, new_rtoffpa + 0.5e0 * (CASE WHEN {headroom} > 0 THEN {headroom} ELSE 0e0 END) * {on_sc} AS new_rtorpa,
         {new_z}
  FROM priced1
),
priced3 AS (SELECT *, {new_p} FROM priced2),
priced AS (SELECT *, {new_spp} FROM priced3)"""


def series_ctes(basis="last_month", outside=False, entry="as_written") -> str:
    """Long table and the dispatch/constraint chain, plain whole-series form."""
    pick_price = " ".join(
        f"WHEN zone = '{z}' AND scenario = 'base' THEN {z}_price WHEN zone = '{z}' THEN new_{z}_price" for z in ZONES
    )
    pick_spp = " ".join(
        f"WHEN zone = '{z}' AND scenario = 'base' THEN {z}_spp WHEN zone = '{z}' THEN new_{z}_spp" for z in ZONES
    )
    if basis == "last_month":
        k_spp = ("(SELECT CASE x.strike_case WHEN 'low' THEN s2.low_spp WHEN 'mid' THEN s2.mid_spp ELSE s2.high_spp END "
                 "FROM strikes s2 WHERE s2.month = (SELECT max(month) FROM cal))")
    else:
        k_spp = "CASE x.strike_case WHEN 'low' THEN low_spp WHEN 'mid' THEN mid_spp ELSE high_spp END"
    inside = "((hour >= w1_start AND hour < w1_end) OR (hour >= w2_start AND hour < w2_end))"
    outside_c = "(hour < w1_start OR (hour >= w1_end AND hour < w2_start) OR hour >= w2_end)"
    if entry == "as_written":
        entry_c = "coalesce(prev_hour < w1_start OR prev_hour < w2_start, false)"
    else:
        entry_c = ("coalesce(((hour >= w1_start AND hour < w1_end) AND NOT (prev_hour >= w1_start AND prev_hour < w1_end)) "
                   "OR ((hour >= w2_start AND hour < w2_end) AND NOT (prev_hour >= w2_start AND prev_hour < w2_end)), false)")
    entered = f"(strike = 1 AND {entry_c})"
    if outside:
        cdisp = (f"CASE WHEN weekday_ok = 1 THEN (CASE WHEN {outside_c} AND min_duration > 0 THEN dispatch "
                 f"WHEN {inside} THEN (CASE WHEN {entered} THEN 1 ELSE dispatch END) ELSE 0 END) ELSE 0 END")
        cmark = f"CASE WHEN cdispatch = 1 OR (strike = 1 AND date_changed) THEN 1 ELSE 0 END"
        out_rule = "CASE WHEN duration >= min_duration THEN NULL ELSE duration END"
    else:
        cdisp = (f"CASE WHEN {outside_c} THEN 0 ELSE (CASE WHEN weekday_ok = 1 THEN "
                 f"(CASE WHEN {entered} THEN 1 ELSE dispatch END) ELSE 0 END) END")
        cmark = f"CASE WHEN cdispatch = 1 OR (strike = 1 AND date_changed AND {inside}) THEN 1 ELSE 0 END"
        out_rule = "NULL"
    run = f"ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
cases AS (
  SELECT * FROM (VALUES ('lz_north', 0), ('lz_houston', 1), ('lz_south', 2), ('lz_west', 3)) AS zz(zone, zone_ord),
                (VALUES ('base'), ('new_ordc')) AS ss(scenario),
                (VALUES ('low', 0), ('mid', 1), ('high', 2)) AS cc(strike_case, case_ord)
),
long0 AS (
  SELECT x.zone, x.zone_ord, x.scenario, x.strike_case, x.case_ord, p.*,
         CASE {pick_price} END AS price,
         CASE {pick_spp} END AS spp,
         CASE x.strike_case WHEN 'low' THEN low_lmp WHEN 'mid' THEN mid_lmp ELSE high_lmp END AS k_lmp,
         {k_spp} AS k_spp
  FROM priced p, cases x
),
l1 AS (
  SELECT *, max(CASE WHEN price > k_lmp THEN 1 ELSE 0 END)
            OVER (PARTITION BY {SER}, date, hour, "interval" {run}) AS strike
  FROM long0
),
l2 AS (
  SELECT *, lag(strike) OVER (PARTITION BY {SER} ORDER BY {ORD}) AS prev_strike,
         (lag(date) OVER (PARTITION BY {SER} ORDER BY {ORD})) IS DISTINCT FROM date AS date_changed
  FROM l1
),
l3 AS (SELECT *, CASE WHEN strike = 1 AND prev_strike = 0 THEN 1 ELSE 0 END AS dispatch FROM l2),
l4 AS (
  SELECT *, CAST(nullif(sum(CASE WHEN dispatch = 1 OR (strike = 1 AND date_changed) THEN 1 ELSE 0 END)
                         OVER (PARTITION BY {SER}, date {run}), 0) AS BIGINT) AS event
  FROM l3
),
l5 AS (
  SELECT *, CASE WHEN strike = 1 AND event IS NOT NULL
                 THEN (1e0 / 60e0) * sum(tick_secs) OVER (PARTITION BY {SER}, date, event {run}) END AS duration
  FROM l4
),
l6 AS (
  SELECT *, CASE WHEN event IS NOT NULL THEN max(duration) OVER (PARTITION BY {SER}, date, event) END AS event_max_duration,
         CASE WHEN dispatch = 1 THEN 0.2e0 * (spp - k_spp) ELSE strike * (spp - k_spp) END * 0.25e0 * weight AS value,
         {cdisp} AS cdispatch
  FROM l5
),
l7 AS (SELECT *, {cmark} AS cmarker FROM l6),
l8 AS (
  SELECT *, CAST(nullif(sum(cmarker) OVER (PARTITION BY {SER}, date {run}), 0) AS BIGINT) AS cevent,
         CASE WHEN event_max_duration >= min_duration AND {inside} AND cmarker = 1 THEN 1 ELSE 0 END AS qualifying
  FROM l7
),
l9 AS (SELECT *, CAST(nullif(sum(qualifying) OVER (PARTITION BY {SER}, date {run}), 0) AS BIGINT) AS daily FROM l8),
l10 AS (
  SELECT *, CAST(nullif(sum(CASE WHEN daily <= daily_max THEN qualifying ELSE 0 END)
                         OVER (PARTITION BY {SER}, week, year {run}), 0) AS BIGINT) AS weekly,
         CASE WHEN strike = 1 AND cevent IS NOT NULL
              THEN (1e0 / 60e0) * sum(tick_secs) OVER (PARTITION BY {SER}, date, cevent {run}) END AS cdur
  FROM l9
),
l11 AS (
  SELECT *, CASE WHEN {inside} THEN (
              CASE WHEN weekly > weekly_max AND cdur >= min_duration THEN NULL
                   WHEN daily > daily_max AND cdur >= min_duration THEN NULL
                   WHEN cdur > max_duration OR (hour >= w1_end AND hour < w2_start) OR hour >= w2_end THEN NULL
                   ELSE cdur END)
            ELSE {out_rule} END AS cduration
  FROM l10
),
series AS (
  SELECT *, CASE WHEN strike = 1 AND prev_strike = 0 AND cduration IS NOT NULL THEN 0.2e0 * (spp - k_spp)
                 WHEN cduration IS NOT NULL THEN strike * (spp - k_spp) ELSE 0e0 END * 0.25e0 * weight AS cvalue
  FROM l11
)"""


def with_ctes(body: str, series: bool = False, constraints: dict | None = None, **series_opts) -> str:
    ctes = f"constr AS (SELECT * FROM {_constraints(**(constraints or {}))}),\n" + base_ctes()
    if series:
        ctes += ",\n" + series_ctes(**series_opts)
    return f"WITH {ctes}\n{body}"


def rnd(x: str, d: int) -> str:
    """numpy's rounding: scale, round half to even, unscale; -0.0 -> 0.0."""
    if d == 0:
        return f"(round_even({x}, 0) + 0e0)"
    return f"(round_even(({x}) * {10 ** d}e0, 0) / {10 ** d}e0 + 0e0)"


def r4(x: str) -> str:
    return rnd(x, 4)


SERIES_KEYS = "zone, scenario, strike_case, tick_id"


def month_cells(prefix_expr: str, count_ok: str = "n") -> str:
    return ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE month = {m}) > 0 THEN "
        f"{rnd(f'coalesce(sum({prefix_expr}) FILTER (WHERE month = {m}), 0e0)', 0)} END AS m{m:02d}"
        for m in range(1, 13)
    )


def queries() -> dict[str, str]:
    zc = ", ".join(r4(z) + f" AS {z}" for z, _ in ZONE_FACTORS)
    q = {}
    q["tick_scan"] = with_ctes(
        f"SELECT tick_id, ts, repeated_hour, {zc}, {r4('system_lambda')} AS system_lambda, "
        f"{r4('rtorpa')} AS rtorpa, {r4('rtoffpa')} AS rtoffpa, {r4('rtordpa')} AS rtordpa, "
        f"{r4('rtolcap')} AS rtolcap, {r4('rtoffcap')} AS rtoffcap FROM raw_ticks")
    q["calendar_columns"] = with_ctes(
        "SELECT tick_id, date, year, month, day, weekday, "
        "list_extract(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'], weekday + 1) AS weekday_name, "
        "week, hour, minute, second, \"interval\", season FROM cal")
    spp_out = ", ".join(f"{r4(f'{n}_spp')} AS {n}_spp" for n in ("hb_north",) + ZONES)
    q["settlement_pivot"] = with_ctes(f"SELECT date, hour, \"interval\", repeated_hour, {spp_out} FROM spp")
    q["tick_seconds"] = with_ctes(f"SELECT tick_id, {r4('tick_secs')} AS tick_secs, day_start, prev_hour FROM timed")
    q["interval_seconds"] = with_ctes(
        f"SELECT tick_id, {r4('interval_secs')} AS interval_secs, {rnd('weight', 6)} AS weight FROM timed")
    q["base_price"] = with_ctes(
        "SELECT tick_id, " + ", ".join(f"{r4(f'{z}_price')} AS {z}_price" for z in ZONES) + " FROM priced")
    q["enriched_ticks"] = with_ctes(
        f"SELECT tick_id, season, lolp_mu, lolp_sigma, {spp_out}, low_spp, mid_spp, high_spp, low_lmp, mid_lmp, high_lmp, "
        "daily_max, weekly_max, min_duration, max_duration, w1_start, w1_end, w2_start, w2_end, weekday_ok FROM enriched")
    q["normal_cdf"] = with_ctes(
        "SELECT tick_id, "
        + rnd(_ncdf("(rtolcap + rtoffcap) - 3000e0", "lolp_mu", "lolp_sigma"), 10)
        + " AS off_cdf, "
        + rnd(_ncdf("rtolcap - 3000e0", "0.5e0 * lolp_mu", "0.707e0 * lolp_sigma"), 10)
        + " AS on_cdf FROM enriched")
    q["new_ordc_adders"] = with_ctes(
        f"SELECT tick_id, {r4('lambda_capped')} AS lambda_capped, {r4('new_rtoffpa')} AS new_rtoffpa, "
        f"{r4('new_rtorpa')} AS new_rtorpa FROM priced")
    q["new_ordc_price"] = with_ctes(
        "SELECT tick_id, " + ", ".join(f"{r4(f'new_{z}')} AS new_{z}, {r4(f'new_{z}_price')} AS new_{z}_price"
                                        for z in ZONES) + " FROM priced")
    q["new_ordc_settlement"] = with_ctes(
        "SELECT tick_id, " + ", ".join(f"{r4(f'new_{z}_spp')} AS new_{z}_spp" for z in ZONES) + " FROM priced")

    def sq(cols: str, **kw) -> str:
        return with_ctes(f"SELECT {SERIES_KEYS}, {cols} FROM series", series=True, **kw)

    # three chains whose oracle has another form than the windows above: a strike
    # is found by looking for a price above the strike earlier in the quarter
    # hour, events and caps by counting earlier starts
    same = "e.zone = s.zone AND e.scenario = s.scenario AND e.strike_case = s.strike_case"
    before = "(date_trunc('hour', e.ts), e.repeated_hour = 'Y', e.ts, e.tick_id) <= (date_trunc('hour', s.ts), s.repeated_hour = 'Y', s.ts, s.tick_id)"
    q["strike_flags"] = with_ctes(
        "SELECT s.zone, s.scenario, s.strike_case, s.tick_id, CAST(count(e.tick_id) > 0 AS INTEGER) AS strike "
        f"FROM long0 s LEFT JOIN (SELECT * FROM long0 WHERE price > k_lmp) e ON {same} AND e.date = s.date "
        f"AND e.hour = s.hour AND e.\"interval\" = s.\"interval\" AND {before} GROUP BY 1, 2, 3, 4", series=True)
    q["dispatch_starts"] = sq("dispatch, prev_strike")
    q["daily_events"] = with_ctes(
        "SELECT s.zone, s.scenario, s.strike_case, s.tick_id, nullif(count(e.tick_id), 0) AS event FROM l3 s "
        "LEFT JOIN (SELECT * FROM l3 WHERE dispatch = 1 OR (strike = 1 AND date_changed)) e "
        f"ON {same} AND e.date = s.date AND {before} GROUP BY 1, 2, 3, 4", series=True)
    q["event_durations"] = sq(f"{r4('duration')} AS duration, {r4('event_max_duration')} AS event_max_duration")
    q["tick_value_last_month"] = sq(f"{r4('value')} AS value")
    q["tick_value_row_month"] = sq(f"{r4('value')} AS value", basis="row_month")
    q["constrained_dispatch"] = sq("cdispatch")
    q["constrained_dispatch_outside"] = sq("cdispatch", outside=True)
    q["constrained_dispatch_boundary"] = sq("cdispatch", entry="boundary")
    q["constrained_dispatch_weekdays"] = sq(
        "cdispatch, cevent", constraints={"days": (1, 1, 1, 1, 0, 0, 1)})
    q["constrained_events"] = sq("cmarker, cevent, qualifying")
    q["event_caps"] = with_ctes(
        "SELECT s.zone, s.scenario, s.strike_case, s.tick_id, nullif(count(e.tick_id) FILTER (WHERE e.date = s.date), 0) AS daily, "
        "nullif(count(e.tick_id) FILTER (WHERE e.daily <= e.daily_max), 0) AS weekly FROM l8 s "
        "LEFT JOIN (SELECT * FROM l9 WHERE qualifying = 1) e "
        f"ON {same} AND e.week = s.week AND e.year = s.year AND {before} GROUP BY 1, 2, 3, 4", series=True)
    q["event_caps_weekly25"] = sq("daily, weekly", constraints={"weekly_max": 25})
    q["constrained_durations"] = sq(f"{r4('cduration')} AS cduration")
    q["constrained_durations_outside"] = sq(f"{r4('cduration')} AS cduration", outside=True)
    q["constrained_durations_weekly25"] = sq(f"{r4('cduration')} AS cduration", constraints={"weekly_max": 25})
    q["constrained_durations_max30"] = sq(f"{r4('cduration')} AS cduration", constraints={"max_duration": 30})
    q["constrained_value"] = sq(f"{r4('cvalue')} AS cvalue")

    mv_keys = "scenario, zone, strike_case, year"
    q["monthly_value"] = with_ctes(
        f"SELECT {mv_keys}, false AS constrained, {month_cells('value')} FROM series GROUP BY {mv_keys} "
        f"UNION ALL SELECT {mv_keys}, true AS constrained, {month_cells('cvalue')} FROM series GROUP BY {mv_keys}",
        series=True)
    q["strike_counts"] = with_ctes(
        "SELECT scenario, zone, strike_case, year, hour, "
        + ", ".join(f"CASE WHEN count(*) FILTER (WHERE month = {m}) > 0 THEN "
                    f"CAST(coalesce(sum(strike) FILTER (WHERE month = {m}), 0) AS BIGINT) END AS m{m:02d}"
                    for m in range(1, 13))
        + " FROM series GROUP BY scenario, zone, strike_case, year, hour",
        series=True)
    q["duration_report_base"] = with_ctes(_duration_report_sql("base"), series=True)
    q["duration_report_new_ordc"] = with_ctes(_duration_report_sql("new_ordc"), series=True)
    q["monthly_value_long_prices"] = q["monthly_value_extended"] = q["monthly_value"]
    ctes, report = q["duration_report_base"].rsplit("\nSELECT", 1)
    cells = ", ".join(f"CASE WHEN zone = '{z}' THEN {d}_{c} END AS {z}_{d}_{c}" for z in ZONES for d in ("dur", "cdur") for c in ("low", "mid", "high"))
    q["duration_report_by_zone"] = f"{ctes}\nSELECT zone, year, month, day, event, {cells} FROM (SELECT{report})"
    return q


def _duration_report_sql(scenario: str) -> str:
    """One frame per (case, constrained) keyed by its event column, then left
    joins onto the low/unconstrained frame (the original's merge chain)."""
    def frame(case: str, col: str, key: str) -> str:
        return (f"(SELECT s.zone, s.year, s.month, s.day, lo.{key} AS event, max({rnd(f's.{col}', 1)}) AS v "
                f"FROM series s JOIN series lo ON lo.zone = s.zone AND lo.scenario = s.scenario "
                f"AND lo.tick_id = s.tick_id AND lo.strike_case = 'low' "
                f"WHERE s.scenario = '{scenario}' AND s.strike_case = '{case}' AND lo.{key} IS NOT NULL "
                f"GROUP BY 1, 2, 3, 4, 5 HAVING max(s.{col}) IS NOT NULL)")
    ckey = "event" if scenario == "base" else "cevent"
    parts = [("dur_low", frame("low", "duration", "event"))]
    parts += [(f"dur_{c}", frame(c, "duration", "event")) for c in ("mid", "high")]
    parts += [(f"cdur_{c}", frame(c, "cduration", ckey)) for c in ("low", "mid", "high")]
    sel = ", ".join(f"{name}.v AS {name}" for name, _ in parts)
    sql = f"SELECT dur_low.zone, dur_low.year, dur_low.month, dur_low.day, CAST(dur_low.event AS INTEGER) AS event, {sel} FROM {parts[0][1]} dur_low"
    for name, f in parts[1:]:
        sql += (f" LEFT JOIN {f} {name} ON {name}.zone = dur_low.zone AND {name}.year = dur_low.year "
                f"AND {name}.month = dur_low.month AND {name}.day = dur_low.day AND {name}.event = dur_low.event")
    return sql
