"""New data appended to old: reports extended without reading earlier ticks.

``History`` keeps, in a shared folder, what earlier ticks leave behind:

* the facts of all closed dates (``operators.reports.facts``), from which any report is made;
* the flag of each series' last tick, the events of weeks already begun, the last hour;
* the ticks and settlement prices of the open date, the last one present: its
  last tick has no known length yet.

``extend`` reads the new rows and the open date's, closes all dates but the
last, and publishes the new state by a manifest written last.  Reports are made
from the stored facts and the open date, and equal those of one run over all data.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikeflow import schemas
from strikeflow.operators.settlement import delivery_date
from strikeflow.params import Params
from strikeflow.plans.model import DispatchModel, report_tables
from strikeflow.session import Staged
from strikeflow.sources.manifest import Manifests


class LateTicksError(ValueError):
    pass


class OtherParametersError(ValueError):
    pass


@dataclass(frozen=True)
class Past:
    """What earlier data leaves to a model of later dates: the last hour and latest month before, as
    (date, hour, month); per series the ``last`` flag; per series, year and ISO week the events so far."""

    edge: tuple | None
    last: DataFrame | None
    weeks: DataFrame | None


def fingerprint(p: Params) -> str:
    """Of the parameters that the facts depend on: all but the valuation strikes."""
    kept = {k: v for k, v in vars(p).items() if k not in ("strikes_spp", "strike_basis")}
    return hashlib.sha256(repr(sorted(kept.items())).encode()).hexdigest()


class History:
    """The reports of a growing tick stream; ``folder`` is one that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, lolp: DataFrame, params: Params | None = None, partitions: int | None = None):
        self.spark, self.lolp, self.p, self.partitions = spark, lolp, params or Params(), partitions
        self.manifests = Manifests(spark, folder)
        self.staged = Staged(spark)

    def _state(self) -> tuple[int, dict]:
        number, state = self.manifests.read()
        if state and state["parameters"] != fingerprint(self.p):
            raise OtherParametersError("the history was made with other parameters; only valuation strikes may change")
        return number, state or {"parameters": fingerprint(self.p), "facts": [], "edge": None, "open": None, "tables": None}

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifests.root}/{path}")

    def _model(self, state: dict, ticks: DataFrame, settlement: DataFrame) -> DispatchModel:
        edge, at = state["edge"], state["tables"]
        past = Past(edge and tuple(edge), self._read(f"{at}/last"), self._read(f"{at}/weeks")) if edge else None
        model = DispatchModel(ticks, settlement, self.lolp, self.p, self.partitions, past=past)
        model.staged = self.staged
        self.staged.root = None  # a folder of its own for each model
        return model

    def extend(self, ticks: DataFrame, settlement: DataFrame) -> int:
        """Adds later ticks and settlement prices; the number of the new state.

        Ticks must not lie before the open date, and a quarter hour's settlement
        prices must come with its ticks or before.  No ticks: nothing changes."""
        number, state = self._state()
        ticks, settlement = ticks.select(*schemas.TICK_COLUMNS), settlement.select(*[f.name for f in schemas.SETTLEMENT.fields])
        span = ticks.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last")).first()
        if span["first"] is None:
            return number
        if state["open"] and str(span["first"]) < state["open"]:
            raise LateTicksError(f"ticks of {span['first']}, but all dates before {state['open']} are closed")
        if state["open"]:
            ticks = ticks.unionByName(self._read(f"{state['tables']}/ticks"))
            settlement = settlement.unionByName(self._read(f"{state['tables']}/settlement"))
        run = f"run-{uuid.uuid4().hex}"
        write = lambda df, name: df.write.parquet(f"{self.manifests.root}/{run}/{name}")

        model = self._model(state, ticks, settlement)
        closed = F.col("date") < F.lit(span["last"])
        carries = model.carries.filter(closed)
        last = carries.groupBy("zone_ord", "x").agg(F.max_by("any", F.struct("date", "hour", "second_pass", "interval")).alias("last"))
        weeks = carries.groupBy("zone_ord", "x", "year", "week").agg(F.max("w_end").alias("n"))
        if model.past:
            # a series without closed dates in this run keeps its flag
            last = last.withColumn("new", F.lit(1)).unionByName(model.past.last.withColumn("new", F.lit(0))).groupBy("zone_ord", "x").agg(F.max_by("last", "new").alias("last"))
            weeks = weeks.unionByName(model.past.weeks).groupBy("zone_ord", "x", "year", "week").agg(F.max("n").alias("n"))
        ended = model.calendar_ticks.filter(closed).agg(F.max(F.struct("date", "hour")).alias("at"), F.max("month").alias("month")).first()
        facts = state["facts"]
        if ended["at"] is not None:
            write(model.facts.filter(closed), "facts")
            facts = [*facts, f"{run}/facts"]
        write(last, "last")
        write(weeks.filter(F.col("year") >= span["last"].year), "weeks")  # the week goes with the calendar year
        write(ticks.filter(F.to_date("ts") == F.lit(span["last"])), "ticks")
        write(settlement.filter(F.coalesce(delivery_date() >= F.lit(span["last"]), F.lit(False))), "settlement")
        edge = state["edge"]
        if ended["at"] is not None:
            month = max(ended["month"], edge[2] if edge else 0)
            edge = [str(ended["at"]["date"]), ended["at"]["hour"], month]
        state = state | {"facts": facts, "edge": edge, "open": str(span["last"]), "tables": run}
        model.close()
        return self.manifests.publish(number, state)

    def facts(self) -> DataFrame:
        """The facts of all dates: the stored ones, and those of the open date, worked out anew."""
        _, state = self._state()
        if not state["open"]:
            raise ValueError("the history has no ticks yet")
        model = self._model(state, self._read(f"{state['tables']}/ticks"), self._read(f"{state['tables']}/settlement"))
        out = model.facts
        for path in state["facts"]:
            out = out.unionByName(self._read(path))
        return out

    def reports(self, strike_zones=None) -> dict[str, DataFrame]:
        """The nine reports over all data so far, as ``DispatchModel.reports`` makes them."""
        return report_tables(self.spark, self.p, self.facts(), strike_zones)
