"""Helpers that several operators use: tables, staged results, word splitting."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Python workers then find this package where it isn't installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a scratch folder only in local mode.

    Raises RuntimeError on a cluster without that setting, where a folder of
    one machine would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strikeflow-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """A folder of its own under the shared one, for written intermediate tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str, mode: str = "error") -> DataFrame:
        """Write ``df`` and read it again: its lineage ends in the written files."""
        path = f"{self.root}/{name}"
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def quiet_conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings for the jobs run inside the block only."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keeps_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose own columns begin with an underscore: such columns of the given rows get other names on
    the way through, so that they neither clash nor are lost.  Column arguments keep theirs."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own = {a for a in (*args, *options.values()) if isinstance(a, str)}
        prefix = "kept"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_"
        away = {c: f"{prefix}{i}" for i, c in enumerate(docs.columns) if c.startswith("_") and c not in own}
        if not away:
            return operator(docs, *args, **options)
        return operator(docs.withColumnsRenamed(away), *args, **options).withColumnsRenamed({v: k for k, v in away.items()})

    return run


def words(text: Column) -> Column:
    """The maximal runs of non-space characters; null or blank text: an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def workers_quiet() -> None:
    """One thread a task for the libraries that would start their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
