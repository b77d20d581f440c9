"""Text files in, results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """(doc_id, source, text): one row a UTF-8 file; doc_id is a hash of the path."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
    return files.select(F.xxhash64("source").alias("doc_id"), "source", "text")


def output_name(source: Column, tag: str) -> Column:
    """``note.md`` gives ``note.<tag>.md``; a name without extension gets ``.txt``."""
    extended = source.rlike(r"[^/]\.[^./]+\z")
    return F.when(extended, F.regexp_replace(source, r"(\.[^./]+)\z", f".{tag}$1")).otherwise(F.concat(source, F.lit(f".{tag}.txt")))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def with_newline(text: Column) -> Column:
    """Exactly what a text file should hold: a line break at the end."""
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
