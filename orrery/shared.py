"""Files for what has to be computed once, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints that all executors see; where none is set and Spark runs in this process, a local one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='stream')}/stream-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the shared folder."""
    to = scratch(df.sparkSession)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)
