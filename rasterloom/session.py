"""Session defaults that the library's operators are written for, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "rasterloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; ``conf`` overrides (dots written as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders that ``written`` made in this process and nothing has dropped yet.
_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a new local one if the master is local; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _FOLDERS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_pixels(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for tables of many small rows: they are never broadcast, because their files are many times smaller than they are in memory."""
    return written(df, name).hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all shuffle partitions by ``keys``, and never broadcast: for rows that are exploded next.

    Spark judges tasks and joins by the size before an explode. Few rows that become many would be
    exploded in one task, and then broadcast through the driver.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).hint("merge")


def drop_written(spark: SparkSession, keep: int = 0) -> int:
    """Deletes what ``written`` has made, but for the first ``keep`` folders; returns how many went.

    For callers that have consumed or stored their results: tables that still read a dropped
    folder fail.
    """
    gone = 0
    while len(_FOLDERS) > keep:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gone += 1
    return gone


def written_so_far() -> int:
    """How many folders ``drop_written`` would delete."""
    return len(_FOLDERS)
