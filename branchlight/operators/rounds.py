"""State between the rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: that of the session, else of spark.checkpoint.dir, else a temporary one if the driver is also the only executor."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="branchlight-ckpt-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the checkpoint folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
