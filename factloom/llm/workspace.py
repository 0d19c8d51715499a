"""Tables in the cluster's shared folder: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import ship_by_value

ship_by_value(__name__)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; else a folder for this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        folder = "file://" + tempfile.mkdtemp(prefix="factloom-")
    else:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_factloom"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def session_folder(spark: SparkSession) -> str:
    """Where this application's tables lie."""
    return f"{shared_folder(spark).rstrip('/')}/factloom-{spark.sparkContext.applicationId}"


def clear_workspaces(spark: SparkSession) -> None:
    """Delete all tables of this application; results that weren't written elsewhere can't be read any more."""
    _delete(spark, session_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Workspace:
    """A folder of its own for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return the table read back."""
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._factloom_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            _delete(self.spark, table._factloom_path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts holds.

    Spark reads these settings when a result is planned, after the operator has
    returned, so they hold for the rest of the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
