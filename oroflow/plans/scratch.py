"""Tables that cut the lineage of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="oroflow-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/oroflow-plans"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The table, read from a folder of its own. Files of cells are a small part of what they hold, so joins with it sort
    and merge: by the files' size Spark would send whole rasters to every task. With `by`, a folder for each value of that
    column."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")
