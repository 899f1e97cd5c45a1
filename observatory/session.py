"""Session building and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "observatory", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE picks partition counts, join sides and skew splits at run time; the
    session zone is UTC because every timestamp in the model is naive UTC.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a machine-local folder: on a cluster
    a missing setting is an error, because a lost executor would take the
    lineage cut with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = os.environ.get("OBSERVATORY_LOCAL_DIR") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage with storage that outlives any executor, keeps the schema and
    gives the planner exact sizes for whatever comes next.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The table an iterative job grows: one folder per round, read as a whole.

    Each round is one write job; its row count rides on the write, so no job
    runs just to see whether the loop is done. Rounds already written are never
    touched again, and a lost executor only repeats the round it was in.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_path(spark, label)
        self.n, self.schema = 0, None

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """Write a round; returns it read back, and how many rows it has."""
        path = f"{self.root}/round={self.n}"
        seen = Observation(f"round{self.n}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.n += 1
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path), int(seen.get["n"])

    def read(self) -> DataFrame:
        """All rounds so far with their number as ``round``."""
        paths = [f"{self.root}/round={i}" for i in range(self.n)]
        reader = self.spark.read.schema(self.schema).option("basePath", self.root)
        return reader.parquet(*paths)
