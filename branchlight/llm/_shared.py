"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python; bounds a worker's memory however long the texts are.
BATCH_BYTES = 4 << 20


def session_ready(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes and make sure that checkpoint() has a folder.

    The folder is the one in spark.checkpoint.dir; only on a local master where that is unset (tests, a laptop), whose driver is its one executor,
    a temporary one is made. A cluster, local-cluster included, without that setting is an error, as its executors share no local folder.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="branchlight-ckpt-"))
    return spark


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the checkpoint folder and read from there: a later reader of two columns reads two columns."""
    spark = session_ready(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, *frames: DataFrame) -> str:
    """The name, or one with underscores behind it, that no column of the frames has (letter case aside)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def struct_of(fields: dict[str, tuple[pa.DataType, list]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v, t) for t, v in fields.values()], names=list(fields))


def training_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as bucket 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def slices(df: DataFrame, least: int = 1) -> int:
    """How many slices to cut df into: as many as it has partitions, so that it follows the input."""
    return max(least, df.rdd.getNumPartitions())
