"""The session's settings that the receipt jobs rely on."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on or that a large cluster wants; sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "tillroll", **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword names take underscores for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root or os.path.join(tempfile.gettempdir(), 'tillroll-shared')}/tillroll/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores, dealt out to all of them before costly work on each row; other tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def workspace(spark: SparkSession, label: str):
    """A function that writes a frame below a folder of its own, in the shared one, and reads it back, which cuts its lineage; the folder goes at the end."""
    root = scratch(spark, label)

    def written(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield written
    finally:
        remove(spark, root)
