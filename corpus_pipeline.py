"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

Cases, for every stage: an empty table gives an empty one; null and empty texts stay until the packing, where
they take no place; texts of any length are read whole; other columns stay as they are, whatever their names.
Rows without a doc_id pass toxicity by their text, stay among near copies and in the decontamination (nothing
can name them), count last among repeats and are packed as null.  Repeated rows are alike in every stage: all
stay or all go, and each is packed.  A doc_id with several texts is judged text by text for toxicity and
repeats; it goes as a near copy only if all its texts are, and as contaminated if one is.  Ties are broken by
the least doc_id, which stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import core, decontaminate, ngram_join, packing, suffix_repeats, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the labels train it."""
    return toxicity.without_toxic(docs, core.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return _without(docs, ngram_join.representatives(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only in the document with the least doc_id; the rest of the others stays."""
    return suffix_repeats.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage, word by word or nearly so, go."""
    return _without(docs, decontaminate.contaminated(docs, core.table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shortest-pack-first packing of all that the other stages kept."""
    return packing.pack_documents(docs)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``gone`` (distinct doc_ids); null doc_ids stay."""
    at = docs.columns.index("doc_id")
    names = [f"c{i}" for i in range(len(docs.columns))]
    gone = gone.select(F.col("doc_id").alias("gone"))
    return docs.toDF(*names).join(gone, F.col(f"c{at}") == F.col("gone"), "left_anti").toDF(*docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the packing are not SQL: the tests hold each stage against brute force on what it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = core.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = core.kept(docs, f"stage-{k}")
    return docs
