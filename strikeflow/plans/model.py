"""The dispatch-valuation pipeline.

Physical shape (see README "Plan"):

1. ticks are hash-partitioned by (date, hour) once; tick-level windows (tick
   length, quarter-hour weights) run inside it; what crosses an hour comes from
   one per-hour summary (<= 24 rows per day) that joins on the same keys; the
   parameter tables (4 and 12 rows) are broadcast;
2. a row per zone is made of each tick and shuffled once by (zone, date, hour);
   the six series of a zone stand side by side, and one sort serves all windows;
3. each quarter hour is reduced to a narrow carry; the carries are scanned by
   series, day and week, written once (``carries``) and joined back, so no
   window looks beyond a quarter hour of ticks;
4. reports are partial/final aggregates of small width; strike counts need
   neither carries nor settlement prices.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow.operators import carries as CA
from strikeflow.operators import dispatch as D
from strikeflow.operators import enrich as E
from strikeflow.operators import pricing as P
from strikeflow.operators import reports as R
from strikeflow.operators import series as S
from strikeflow.operators import settlement as ST
from strikeflow.operators import ticks as TK
from strikeflow.operators import zones as Z
from strikeflow.params import SCENARIOS, Params, constraint_table, strike_table
from strikeflow.session import Staged
from strikeflow.sources.fixtures import load_fixture


class DispatchModel:
    def __init__(
        self,
        ticks: DataFrame,
        settlement: DataFrame,
        lolp: DataFrame,
        params: Params | None = None,
        partitions: int | None = None,
        prices: DataFrame | None = None,
        past: "Past | None" = None,
    ):
        """``prices``: zone prices as a long table (tick_id, ts, point, lmp) instead of columns of ``ticks``, for any
        number of points; ``past``: what earlier data left behind (``plans.incremental``)."""
        self.spark: SparkSession = ticks.sparkSession
        self.raw_ticks = ticks
        self.settlement = settlement
        self.lolp = E.distinct_lolp(lolp)
        self.p = params or Params()
        self.partitions = partitions
        self.prices = prices
        self.past = past
        self.staged = Staged(self.spark)
        E.check_lolp_unique(self.lolp)

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str, params: Params | None = None, **kw) -> "DispatchModel":
        ticks, spp, lolp = load_fixture(spark, sf_dir)
        return cls(ticks, spp, lolp, params, **kw)

    @property
    def n_partitions(self) -> int:
        """Partitions of the tick and series shuffles (``spark.sql.shuffle.partitions``
        unless given)."""
        return self.partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    # -- tick table --------------------------------------------------------
    @cached_property
    def calendar_ticks(self) -> DataFrame:
        return TK.with_calendar(self.raw_ticks, self.p)

    @cached_property
    def settlement_wide(self) -> DataFrame:
        return ST.shape_settlement(self.settlement)

    @cached_property
    def chunk_summary(self) -> DataFrame:
        """One row per (date, hour), from the unshuffled ticks (their timestamps only)."""
        return TK.chunk_summary(self.calendar_ticks, self.p, self.past and self.past.edge)

    @cached_property
    def timed_ticks(self) -> DataFrame:
        """Calendar + tick_secs/day_start/prev_hour + interval weights, hash(date, hour)."""
        t = TK.partition_by_chunk(self.calendar_ticks, self.n_partitions)
        t = t.join(self.chunk_summary, list(TK.CHUNK), "left")
        t = TK.with_tick_seconds_joined(t)
        return TK.with_interval_seconds(t)

    @cached_property
    def enriched_ticks(self) -> DataFrame:
        t = E.join_settlement(self.timed_ticks, self.settlement_wide)
        t = E.join_lolp(t, self.lolp)
        return E.join_month_params(t, strike_table(self.spark, self.p), constraint_table(self.spark, self.p))

    @cached_property
    def priced_ticks(self) -> DataFrame:
        t = P.with_base_price(self.enriched_ticks, self.p.zones)
        t = P.with_new_ordc(t, self.p, self.p.zones)
        return P.with_new_ordc_spp(t, self.p.zones)

    # -- zone table --------------------------------------------------------
    def zone_ticks(self, zones=None, together: bool = False) -> DataFrame:
        """One row per tick and zone with both prices, hash(zone, date, hour); ``together``: see ``partition_zones``."""
        t = P.with_new_adders(E.join_lolp(self.timed_ticks, self.lolp), self.p)
        z = Z.by_zone(t, self.p, zones) if self.prices is None else Z.with_prices(t, self.prices, self.p, zones)
        return Z.with_rules(Z.partition_zones(Z.point_prices(z), self.n_partitions, together), self.p)

    def zone_strikes(self, zones=None, together: bool = False) -> DataFrame:
        """Zone ticks with the sticky strike flags of all their series (the one sort)."""
        return Z.with_strikes(self.zone_ticks(zones, together), self.p)

    def zone_local(self, zones=None, together: bool = False) -> DataFrame:
        """What each quarter hour knows of itself."""
        if zones is None and not together:
            return self._all_zones_local
        return Z.with_local(Z.with_new_spp(self.zone_strikes(zones or self.p.zones, together)), self.p)

    @cached_property
    def _all_zones_local(self) -> DataFrame:
        return self.zone_local(self.p.zones)

    def scanned(self, zones=None, zone_local: DataFrame | None = None) -> DataFrame:
        """The carries of each quarter hour and series."""
        past = self.past
        z = self.zone_local(zones) if zone_local is None else zone_local
        return CA.scan(CA.quarters(z, self.p), self.p, past and past.last, past and past.weeks)

    @cached_property
    def carries(self) -> DataFrame:
        """``scanned``, written once to the shared folder: a narrow row per series and quarter hour."""
        return self.staged.write(self.scanned(), "carries")

    def _zone_series(self, scanned: DataFrame, zone_local: DataFrame, zones=None) -> DataFrame:
        settled = ST.by_chunk(self.settlement, list(self.p.points), Z.zone_ordinals(self.spark, self.p, zones))
        return Z.with_settlement(D.with_carries(Z.with_hours(zone_local, CA.gathered(scanned), settled)))

    @cached_property
    def zone_series(self) -> DataFrame:
        """Zone ticks with both settlement prices and the carries of all their series."""
        return self._zone_series(self.carries, self.zone_local())

    @cached_property
    def facts(self) -> DataFrame:
        """Value sums and strike counts by hour, durations by event: written once, and read by all reports."""
        return self.staged.write(R.facts(self.zone_series, self.p), "facts")

    # -- series table ------------------------------------------------------
    def series_days(self, zones=None, scenarios=None, columns=None) -> DataFrame:
        """The series table of the given zones and scenarios (default: all), with the given series columns (default:
        all); nothing is read or written yet."""
        z = self.zone_local(zones, together=True)
        return S.to_series(self._zone_series(self.scanned(zones, z), z, zones), self.p, scenarios, columns)

    def series_table(self, columns=None) -> DataFrame:
        """One row per tick, zone, scenario and strike case, from the written carries."""
        return S.to_series(self.zone_series, self.p, columns=columns)

    @cached_property
    def series(self) -> DataFrame:
        return self.series_table()

    # -- reports -----------------------------------------------------------
    def monthly_value(self) -> DataFrame:
        return R.monthly_value(self.facts, self.p)

    def duration_report(self, scenario: str = "base") -> DataFrame:
        return R.duration_report(self.facts, self.p, scenario)

    def strike_counts(self, zones=None) -> DataFrame:
        """Strike counts of the given zones, by default all of ``Params.zones``; only their rows are made, and
        neither carries nor settlement prices."""
        return R.strike_counts(R.strike_sums(self.zone_strikes(zones), self.p), self.p)

    def reports(self, strike_zones=None) -> dict[str, DataFrame]:
        """All report tables of one run, keyed by sink name, from the facts.

        ``strike_zones``: zones of the strike counts, by default all of ``Params.zones``."""
        return report_tables(self.spark, self.p, self.facts, strike_zones)

    def close(self) -> None:
        """Removes what this model has written to the shared folder; its tables can't be read afterwards."""
        self.staged.close()


def report_tables(spark: SparkSession, p: Params, facts: DataFrame, strike_zones=None) -> dict[str, DataFrame]:
    """The nine reports by sink name, in report order."""
    out = {}
    values = R.monthly_value(facts, p)
    for scen in SCENARIOS:
        for con in (False, True):
            name = "value" + ("_new_ordc" if scen == "new_ordc" else "") + ("_constrained" if con else "")
            out[name] = R.sort_value_report(values.filter((F.col("scenario") == scen) & (F.col("constrained") == F.lit(con))))
    for scen, name in zip(SCENARIOS, ("duration", "duration_new_ordc")):
        out[name] = R.duration_report(facts, p, scen).orderBy("zone_ord", "year", "month", "day", "event")
    counts = R.strike_counts(R.strike_sums(facts, p), p).filter(F.col("zone").isin(*(strike_zones or p.zones)))
    out["strike_counts"] = counts.orderBy("scenario", "zone_ord", "case_ord", "year", "hour")
    out["strikes"] = R.by_month(strike_table(spark, p))
    out["constraints"] = R.by_month(constraint_table(spark, p))
    return out
