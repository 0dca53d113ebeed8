"""Typed readers for the three market inputs (Parquet or CSV, any Spark source).

The inputs may name their columns as the market operator's files do
(``TICK_NAMES`` and so on) or as this package does; a column that is neither
is ignored, a missing one raises.  The settlement history usually arrives as
one file per year; pass all of them and Spark reads them as one relation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeflow import schemas
from strikeflow.params import CONSTRAINT_SCHEMA, WEEKDAYS, MonthConstraints, Params

# Column names of the operator's files, by the names used here.
TICK_NAMES = {
    "ts": "SCEDTimestamp", "repeated_hour": "RepeatedHourFlag", "hb_north": "HB_NORTH", "lz_north": "LZ_NORTH",
    "lz_houston": "LZ_HOUSTON", "lz_south": "LZ_SOUTH", "lz_west": "LZ_WEST", "system_lambda": "System Lamda",
    "rtorpa": "RTORPA", "rtoffpa": "RTOFFPA", "rtordpa": "RTORDPA", "rtolcap": "RTOLCAP", "rtoffcap": "RTOFFCAP",
}
SETTLEMENT_NAMES = {
    "delivery_date": "Delivery Date", "delivery_hour": "Delivery Hour", "delivery_interval": "Delivery Interval",
    "repeated_hour": "Repeated Hour Flag", "point_name": "Settlement Point Name", "point_type": "Settlement Point Type",
    "price": "Settlement Point Price",
}
LOLP_NAMES = {
    "season": "Season", "start_date": "Start Date", "end_date": "End Date", "start_hour": "Start Hour", "end_hour": "End Hour",
    "lolp_mu": "Average + (0.5 * Stand Deviation)", "lolp_sigma": "Standard Deviation",
}
#: Settlement and season columns that may be missing: the season's dates are never used.
OPTIONAL = frozenset(("start_date", "end_date", "start_hour", "end_hour"))
TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss")


class MissingColumnsError(ValueError):
    pass


def _load(spark: SparkSession, paths, fmt: str, options: dict | None) -> DataFrame:
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    return r.options(**(options or {})).load(paths)


def _timestamp(c: Column) -> Column:
    """Local wall clock from text in any of TS_FORMATS; other texts raise when they are read."""
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in TS_FORMATS])
    bad = F.raise_error(F.concat(F.lit("not a timestamp: "), c)).cast("timestamp_ntz")
    return F.when(c.isNotNull() & parsed.isNull(), bad).otherwise(parsed)


def _typed(df: DataFrame, schema: T.StructType, names: Mapping[str, str], columns: Mapping[str, str] | None) -> DataFrame:
    """``df`` cut to ``schema``; ``columns`` maps this package's names to the file's where they differ from both."""
    out, missing = [], []
    for field in schema.fields:
        given = [n for n in ((columns or {}).get(field.name), field.name, names.get(field.name)) if n in df.columns]
        if given:
            c = F.col(f"`{given[0]}`")
            text = isinstance(df.schema[given[0]].dataType, T.StringType)
            c = _timestamp(c) if text and isinstance(field.dataType, T.TimestampNTZType) else c.cast(field.dataType)
            out.append(c.alias(field.name))
        elif field.name in OPTIONAL:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name != "tick_id":
            missing.append(names[field.name])
    if missing:
        raise MissingColumnsError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*out)


def with_file_order(df: DataFrame, name: str) -> DataFrame:
    """``name``: a number that rises with a row's place in its file, and from file to file by path.

    It does not depend on how Spark splits the files: Parquet knows each row's
    index; elsewhere rows are counted within each block that was read, and a
    block's first byte comes first (a row has a byte at least)."""
    place = ["_metadata.file_path", "_metadata.row_index"] if _has_row_index(df) else ["_metadata.file_path", "_metadata.file_block_start"]
    rows = df.select("*", F.col(place[0]).alias("_file"), F.col(place[1]).alias("_at"))
    if not _has_row_index(df):
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
        block = Window.partitionBy("_file", "_at").orderBy("_row")
        rows = rows.withColumn("_at", F.col("_at") + F.row_number().over(block) - 1).drop("_row")
    files = rows.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).alias("_ordinal"))  # a row a file
    ordered = rows.join(files, "_file").withColumn(name, F.shiftleft(F.col("_ordinal").cast("long") - 1, 40) + F.col("_at"))
    return ordered.drop("_file", "_at", "_ordinal")


def _has_row_index(df: DataFrame) -> bool:
    try:
        return "_at" in df.select(F.col("_metadata.row_index").alias("_at")).columns
    except AnalysisException:
        return False


def read_ticks(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Real-time price ticks, cut to the columns the model uses.

    ``tick_id`` only settles the order of ticks of the same instant.  Where the
    files have none, it follows the file order (``with_file_order``)."""
    raw = _load(spark, path, fmt, options)
    given = (columns or {}).get("tick_id", "tick_id")
    if given not in raw.columns:
        raw = with_file_order(raw, "tick_id")
    return _typed(raw, schemas.TICK, TICK_NAMES, columns).select(*schemas.TICK_COLUMNS)


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Energy prices as a long table (tick_id, ts, point, lmp), for any number of points (``DispatchModel(prices=)``)."""
    return _typed(_load(spark, path, fmt, options), schemas.PRICE, {f.name: f.name for f in schemas.PRICE.fields}, columns)


def _by_month(df: DataFrame, attributes: Sequence[str]) -> dict[int, dict[str, float]]:
    """A parameter table as month -> attribute -> value: a row per month, or, as reports have it, a row per attribute
    with columns m01..m12.  Twelve months and all attributes must be there, each once."""
    if "attribute" in df.columns:
        found = [(m, r["attribute"], r[f"m{m:02d}"]) for r in df.limit(len(attributes) + 1).collect() for m in range(1, 13)]
    else:
        found = [(int(r["month"]), a, r[a]) for r in df.limit(13).collect() for a in attributes if a in df.columns]
    table = {(m, a): float(v) for m, a, v in found if v is not None and a in attributes}
    wanted = {(m, a) for m in range(1, 13) for a in attributes}
    if set(table) != wanted or len(found) != len(wanted):
        raise MissingColumnsError(f"a value per month is needed of {', '.join(attributes)}; missing or repeated: {sorted(wanted - set(table))[:5] or 'rows'}")
    return {m: {a: table[m, a] for a in attributes} for m in range(1, 13)}


def read_params(spark: SparkSession, strikes: str | None = None, constraints: str | None = None, fmt: str = "parquet", options: dict | None = None, base: Params | None = None) -> Params:
    """Parameters with the strikes and constraints of files, in either direction (``_by_month``); others as in ``base``.

    Attributes are those of the reports ``strikes`` and ``constraints``."""
    p = base or Params()
    if strikes:
        t = _by_month(_load(spark, strikes, fmt, options), [f"{c}_{k}" for k in ("spp", "lmp") for c in p.cases])
        p = p.with_options(**{f"strikes_{k}": {m: tuple(t[m][f"{c}_{k}"] for c in p.cases) for m in t} for k in ("spp", "lmp")})
    if constraints:
        names = [f.name for f in CONSTRAINT_SCHEMA.fields if f.name != "month"]
        t = _by_month(_load(spark, constraints, fmt, options), names)
        whole = [n for n in names if n not in ("min_duration", "max_duration", *WEEKDAYS)]
        p = p.with_options(
            constraints={
                m: MonthConstraints(
                    **{n: int(v[n]) for n in whole}, min_duration=v["min_duration"], max_duration=v["max_duration"], days=tuple(int(v[d]) for d in WEEKDAYS)
                )
                for m, v in t.items()
            }
        )
    return p


def read_settlement(spark: SparkSession, paths: Sequence[str] | str, fmt: str = "parquet", options: dict | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Quarter-hour settlement prices (long: one row per point), all years."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _typed(_load(spark, paths, fmt, options), schemas.SETTLEMENT, SETTLEMENT_NAMES, columns)


def read_lolp(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Seasonal loss-of-load parameters."""
    return _typed(_load(spark, path, fmt, options), schemas.LOLP, LOLP_NAMES, columns)
