"""Tables written once to the folder that all executors share, instead of recomputed or kept by one machine."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder once and read it from there; the files go when the application ends."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all that a frame reads (for a scan, of its files), or None where a source doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(n >= 1 << 60 for n in sizes) else sum(sizes)


def spread_over_cores(df: DataFrame) -> DataFrame:
    """A frame that is read in fewer tasks than there are cores, over all of them; the rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of a batch that are turned into Python objects at once.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``PIECE_BYTES``, so that what is made of one of them is soon given away."""
    for b in batches:
        rows = max(1, b.num_rows * PIECE_BYTES // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
