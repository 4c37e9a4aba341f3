"""Session helpers: local sessions for tests, and lineage cuts through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "orthant") -> SparkSession:
    """A session for tests and the bench. A cluster job brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


class Scratch:
    """Written tables that cut the lineage of an iterative job.

    A cut writes the rows once and reads them back, so a lost executor costs a re-read of
    the table and not a replay of every earlier iteration. ``release`` removes tables that
    a later cut has replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._base = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._tables: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self._base}/t{len(self._tables):05d}"
        self._tables.append(path)
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def release(self, keep: int = 1) -> None:
        """Delete all but the last ``keep`` tables."""
        stale = [p for p in self._tables[: max(0, len(self._tables) - keep)] if p]
        jvm = self._spark._jvm
        for path in stale:
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            fs = hadoop_path.getFileSystem(self._spark._jsc.hadoopConfiguration())
            fs.delete(hadoop_path, True)
        self._tables = [None if p in stale else p for p in self._tables]
