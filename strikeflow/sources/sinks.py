"""Report sinks: each report is written as its own dataset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeflow.sources.manifest import Manifests

#: Reports of a dozen rows, written as one file.
SMALL = ("strikes", "constraints")


def _blank_nulls(df: DataFrame) -> DataFrame:
    """Missing values shown as '' (text output only; typed outputs keep NULL)."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_reports(reports: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write ``{name: DataFrame}`` to ``{out_dir}/{name}`` (Parquet or CSV).

    A report's rows are in order within its files and from file to file."""
    for name, df in reports.items():
        path = f"{out_dir}/{name}"
        df = df.coalesce(1) if name in SMALL else df
        if fmt == "csv":
            # '' and not the writer's default "" for empty values, so that they read back as missing
            _blank_nulls(df).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)
        else:
            df.write.mode(mode).parquet(path)


def publish_reports(reports: dict[str, DataFrame], out_dir: str) -> int:
    """Write reports by year, so that readers see all of them change at once; the number of the manifest.

    Years (and reports) that ``reports`` has take the place of those published
    before, other years stay as they are.  Files are written under a name of
    this run, and the manifest that names them last: if the run is lost, the
    reports published before stay readable.
    """
    spark = next(iter(reports.values())).sparkSession
    manifests = Manifests(spark, out_dir)
    number, before = manifests.read()
    run = f"run-{uuid.uuid4().hex}"
    published = dict(before["reports"]) if before else {}
    for name, df in reports.items():
        path, parts = f"{run}/{name}", dict(published.get(name, {}).get("parts", {}))
        if "year" in df.columns:
            df.withColumn("_year", F.col("year")).write.partitionBy("_year").parquet(f"{manifests.root}/{path}")
            found = [n for n in manifests.names(path) if n.startswith("_year=")]
            parts |= {n.removeprefix("_year="): f"{path}/{n}" for n in found}
        else:
            df.coalesce(1).write.parquet(f"{manifests.root}/{path}")
            parts = {"": path}
        published[name] = {"schema": df.schema.jsonValue(), "parts": parts}
    return manifests.publish(number, {"reports": published})


def published_report(spark: SparkSession, out_dir: str, name: str, years=None, number: int | None = None) -> DataFrame:
    """A published report, by default of all years and the latest manifest; only the files of ``years`` are read."""
    manifests = Manifests(spark, out_dir)
    _, content = manifests.read(number)
    if content is None or name not in content["reports"]:
        raise FileNotFoundError(f"no published report {name} in {out_dir}")
    report = content["reports"][name]
    schema = T.StructType.fromJson(report["schema"])
    wanted = [f"{manifests.root}/{path}" for part, path in report["parts"].items() if years is None or part == "" or part in map(str, years)]
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def remove_unpublished(spark: SparkSession, out_dir: str, keep: int = 1) -> list[str]:
    """Removes manifests but the last ``keep``, and the runs that the kept ones don't name (lost ones, too).

    Not to be run while another run is writing."""
    manifests = Manifests(spark, out_dir)
    numbers = sorted(manifests.numbers())
    used = {path.split("/")[0] for n in numbers[-keep:] for r in manifests.read(n)[1]["reports"].values() for path in r["parts"].values()}
    for n in numbers[:-keep]:
        manifests.remove(f"{Manifests.FOLDER}/{n:08d}.json")
    gone = [n for n in manifests.names("") if n.startswith("run-") and n not in used]
    for n in gone:
        manifests.remove(n)
    return gone


def write_ticks(series: DataFrame, out_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The tick table as an output: one row per tick, zone, scenario and strike case with all that was worked out
    for it (``DispatchModel.series``), partitioned by year and month."""
    series.write.mode(mode).partitionBy("year", "month").format(fmt).save(out_dir)
