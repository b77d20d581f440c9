"""Compression of streams: row-local, so a batch plan works on ``readStream`` as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..plans import api


def compress_stream(docs: DataFrame, rate: float = 0.5, **options) -> DataFrame:
    """A streaming ``docs`` compressed; no state, so no watermark is needed."""
    if not docs.isStreaming:
        raise ValueError("docs is not a stream")
    return api.compress_documents(docs, rate, **options)


def resumable_sink(rows: DataFrame, path: str, checkpoint: str, *, key: str = "doc_id") -> DataStreamWriter:
    """Appends rows to Parquet under ``path`` once each: a batch that is replayed skips what is there already."""

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{path}/batch={number}"
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(folder)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
