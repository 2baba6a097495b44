"""Session-level settings: scale limits, the shared work folder and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed defaults; each can be overridden through the session configuration.
MAX_GROUP_ROWS = 4_000_000
MAX_BROADCAST_ROWS = 500_000


def _number(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.panelforge.{name}", str(default)))


def group_limit(spark: SparkSession) -> int:
    """Largest group (one date, one factor-date) that a single task may sort."""
    return _number(spark, "maxGroupRows", MAX_GROUP_ROWS)


def broadcast_limit(spark: SparkSession) -> int:
    return _number(spark, "maxBroadcastRows", MAX_BROADCAST_ROWS)


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the generated projections need, unless the session chose its own.

    HotSpot never compiles methods above 8,000 bytecodes, so larger generated ones run
    interpreted; with this limit Spark splits such projections instead.
    """
    name, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, "8000")
    return spark


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when ``rows`` (a proven upper bound of ``df``) is small enough.

    Beyond the bound the join is left to Spark, which shuffles both sides and lets AQE
    split skewed partitions.
    """
    return F.broadcast(df) if rows <= broadcast_limit(df.sparkSession) else df


def broadcast_checked(df: DataFrame) -> DataFrame:
    """As :func:`broadcast_within`, counting at most limit + 1 rows when no bound is known."""
    limit = broadcast_limit(df.sparkSession)
    return broadcast_within(df, df.limit(limit + 1).count())


def work_folder(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage: ``spark.checkpoint.dir`` of the session.

    A local folder is created only when nothing is configured and the master is local.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return work_folder(spark)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_table(df: DataFrame) -> str:
    """Write ``df`` to a new table in the shared folder and return its path."""
    path = f"{work_folder(df.sparkSession)}/panelforge-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def table_at(df: DataFrame, path: str) -> DataFrame:
    """The table that :func:`write_table` wrote from ``df``."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str | None) -> None:
    """Delete an intermediate table whose readers are done."""
    if path:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage, columnar reuse."""
    return table_at(df, write_table(df))


def small_table(spark: SparkSession, **columns: list) -> DataFrame:
    """Constant table (parameters, candidate names) as a local relation: no Python tasks."""
    return spark.createDataFrame(pa.table(columns))
