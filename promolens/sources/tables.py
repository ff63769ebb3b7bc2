"""Stored tables: Parquet snapshots with an atomic switch, partitioned and bucketed history."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


class Snapshots:
    """Versions of a table under one folder; the newest complete one is current.

    A version is a folder ``v=<number>-<id>`` that Spark's writer commits as a whole
    (its _SUCCESS file comes last). The batch that made it is in its name, so a
    batch that is replayed finds its own version and writes nothing. The newest
    ``keep`` versions stay, older ones are deleted after a write; one writer at a
    time is assumed, as a stream's checkpoint grants it.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(2, keep)

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        path, fs = self._fs()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [n for n in names if n.startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self, schema: StructType) -> DataFrame:
        """The current version; an empty table before the first."""
        done = self.versions()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{done[-1]}")

    def write(self, df: DataFrame, batch: str | None = None) -> str:
        """Writes the next version; returns its name."""
        done = self.versions()
        tag = batch or uuid.uuid4().hex[:12]
        for name in done:
            if name.split("-", 1)[1] == tag:
                return name
        number = int(done[-1][2:12]) + 1 if done else 1
        name = f"v={number:010d}-{tag}"
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        _, fs = self._fs()
        for old in self.versions()[: -self.keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)
        return name


def append_history(history: DataFrame, path: str, batch: str) -> None:
    """Appends observations, partitioned by month; a batch that is replayed replaces its own rows."""
    rows = history.withColumns({"month": F.date_format("observed_at", "yyyy-MM"), "batch": F.lit(batch)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)


def read_history(spark: SparkSession, path: str, schema: StructType, since: datetime | None = None) -> DataFrame:
    """Observations, only the months from ``since`` on."""
    try:
        rows = spark.read.schema(StructType([*schema.fields]).add("month", "string").add("batch", "string")).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    if since is not None:
        rows = rows.filter((F.col("month") >= since.strftime("%Y-%m")) & (F.col("observed_at") >= F.lit(since).cast("timestamp")))
    return rows.drop("month", "batch")


def compact_history(spark: SparkSession, path: str, schema: StructType, table: str, location: str, buckets: int) -> DataFrame:
    """Rewrites a history of many small folders into one file for each of ``buckets`` buckets of external_id, sorted by time.

    A join or grouping on external_id over the result, which is returned and
    registered as ``table``, needs no shuffle of it. ``buckets`` should not be
    below the session's number of shuffle partitions, or Spark deals both sides
    anew. The rows go to a new ``location``; the history stays as it is.
    """
    rows = read_history(spark, path, schema).repartition(buckets, "external_id")
    writer = rows.write.format("parquet").mode("errorifexists").option("path", location)
    writer.bucketBy(buckets, "external_id").sortBy("external_id", "observed_at").saveAsTable(table)
    return spark.table(table)


def open_compacted(spark: SparkSession, schema: StructType, table: str, location: str, buckets: int) -> DataFrame:
    """A compacted history in another session: registers the files that are there."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (external_id) SORTED BY (external_id, observed_at) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(table)


def work_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir`` that is deleted when the application ends; for a local master without that setting a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="promolens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/promolens/{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
