"""Session helpers: stored stages and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on; leaves sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder will do in local mode, and nothing will do on a cluster.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="itemrec-checkpoint-"))
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Let ``checkpoint()`` use the shared folder too."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut lineage on reliable storage, so a lost executor cannot change it.

    A checkpoint would hold whole serialized rows; the columns of a table are compressed and read alone.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return store(df)


def store(df: DataFrame, *partition_by: str) -> DataFrame:
    """Compute once into a Parquet table of the shared folder: columns and row groups are pruned on reading."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    _STORED.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession | None = None) -> None:
    """Delete what ``store`` has written; call it once the results that read it are written."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _STORED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(hadoop).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the session may be gone already
        _STORED.clear()


def stored_bytes(table: DataFrame) -> int:
    """Size of a stored table by its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_checked(df: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """Store a summary table and broadcast it if its files are small, else leave the join to the planner."""
    table = store(df)
    return F.broadcast(table) if stored_bytes(table) <= max_bytes else table
