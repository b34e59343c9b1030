"""Materialisation that survives lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; where that is unset, a temporary one for a local master only."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = path or tempfile.mkdtemp(prefix="newsloom-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
