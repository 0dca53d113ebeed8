"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.

Each query is executed in full from the parquet input (``noop`` sink, no
collect).  The report queries share one ``DispatchModel`` object, as a user
running several reports would: the first of them also writes the carries and
the facts that others read.  ``all_reports`` is the production path of a model
of its own: both are written once, and nine Parquet reports are made from them.  A warm-up on the smallest fixture runs first so JVM start-up is not
billed to a query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, _HERE)

from strikeflow.plans.queries import QUERIES  # noqa: E402  (warm-up)
from strikeflow.plans.model import DispatchModel  # noqa: E402
from strikeflow.session import local_session  # noqa: E402
from strikeflow.sources import write_reports  # noqa: E402

HEADLINE = (
    "monthly_value",
    "duration_report_base",
    "duration_report_new_ordc",
    "strike_counts",
    "constrained_value",
)


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "32")))
    spark.sparkContext.setLogLevel("ERROR")

    _run(QUERIES["monthly_value"](spark, "/root/testdata/sf0.001"))  # warm-up

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    model = DispatchModel.from_fixture(spark, sf_dir)
    plans = {
        "monthly_value": lambda: model.monthly_value(),
        "duration_report_base": lambda: model.duration_report("base"),
        "duration_report_new_ordc": lambda: model.duration_report("new_ordc"),
        "strike_counts": lambda: model.strike_counts(),
        "constrained_value": lambda: model.series_table(("cvalue",)).select("zone", "scenario", "strike_case", "tick_id", "cvalue"),
    }
    for name in HEADLINE:
        _run(plans[name]())
        times[name] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()

    # all nine reports of one run from one model
    t0 = time.perf_counter()
    model = DispatchModel.from_fixture(spark, sf_dir)
    write_reports(model.reports(), tempfile.mkdtemp(prefix="strikeflow-bench-"))
    times["all_reports"] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
