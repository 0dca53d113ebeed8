"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strikeflow") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # the model's plan is wide (about 100 tick columns, 24 series); constraint
        # inference over it costs seconds of driver time and finds nothing useful
        .config("spark.sql.constraintPropagation.enabled", "false")
        # the model writes out each series' columns; noting where each was written costs more than analysing it
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STRIKEFLOW_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Where none is configured, a scratch folder is set in local mode (tests);
    on a cluster, where a folder of one machine would not do, it raises."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="strikeflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


class Staged:
    """Tables written to the shared folder, in a folder of their own, until ``close``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root: str | None = None

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again: computed once, and its
        lineage ends in files that outlive a lost executor."""
        if self.root is None:
            self.root = f"{checkpoint_dir(self.spark).rstrip('/')}/strikeflow-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self.root is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.root = None
