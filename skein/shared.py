"""The folder that driver and executors share, and versions of a table within one."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where the session names none and all is one machine, a local folder is chosen and set."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = f"/tmp/checkpoints/skein-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder, so that lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """The complete versions version-<n> of a table in a folder, by number."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if re.fullmatch(r"version-\d+", n) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return {int(n.split("-")[1]): f"{root}/{n}" for n in done}
