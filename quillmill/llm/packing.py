"""Shortest-pack-first packing over the length histogram.

Only the histogram of lengths (at most ``max_len`` rows, whatever the corpus) reaches the driver.
There the lengths are placed longest first: all pieces of one length go, as many at a time as
there are packs, into the packing pattern with the most room, and only the counts of patterns
change.  Patterns then become rank intervals for each length, and every piece finds its pack by
its rank among the pieces of its length.  Ranks are made in two steps, inside small groups and by
the groups' running totals, so that no length is ranked in a single task.

Texts longer than ``max_len`` words are cut into whole pieces of ``max_len`` and a rest.
Cases: null or empty texts have no words and take no place; rows repeated under one doc_id are
packed once for each row; a null doc_id is packed as null; texts of any length are packed whole, in
pieces; an empty table gives an empty result; other columns, of whatever name, are ignored.
Ties of length are ordered by doc_id and piece; repeated rows cannot be told apart in the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

MAX_LEN = 2048
RANK_GROUPS = 64


def place(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns and their counts.  Work depends on the number of lengths, not of documents.

    The same packs as if each piece, longest first, went into the pack with the most room, or into a
    new one where it fits into none.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    heap: list[int] = []  # the rooms that have open packs, largest first

    def put(space: int, count: int, pattern: tuple[int, ...]) -> None:
        if not open_.get(space):
            heapq.heappush(heap, -space)
        open_.setdefault(space, []).append((count, pattern))

    for length in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        left = histogram[length]
        while left:
            while heap and not open_.get(-heap[0]):
                heapq.heappop(heap)
            space = -heap[0] if heap else 0
            if space < length:
                # New packs one after the other: each takes as many of this length as it can.
                each = max_len // length
                if left >= each:
                    put(max_len - each * length, left // each, (length,) * each)
                if left % each:
                    put(max_len - left % each * length, 1, (length,) * (left % each))
                break
            count, pattern = open_[space].pop()
            use = min(count, left)
            if use < count:
                open_[space].append((count - use, pattern))
            put(space - length, use, (*pattern, length))
            left -= use
    found: dict[tuple[int, ...], int] = {}
    for entries in open_.values():
        for count, pattern in entries:
            found[pattern] = found.get(pattern, 0) + count
    return sorted(((c, p) for p, c in found.items()), key=lambda x: tuple(-v for v in x[1]))


def intervals(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple]:
    """(length, first rank, end rank, first pack, slot, offset in the pack) of every place."""
    out, next_rank, pack = [], {}, 0
    for count, pattern in patterns:
        at = 0
        for slot, length in enumerate(pattern):
            lo = next_rank.get(length, 0)
            next_rank[length] = lo + count
            out.append((length, lo, lo + count, pack, slot, at))
            at += length
        pack += count
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in core.slices(batch):
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(core.words_of(b.column("text"), fold=False).off))], names=["doc_id", "words"])


def pack_documents(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(pack_id, slot, pack_offset, doc_id, piece, first_word, n_words) of every piece."""
    spark = docs.sparkSession
    base = core.pick(docs, "doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    counts = core.kept(base.mapInArrow(core.lean(_counts), f"doc_id {kind}, words bigint").where("words > 0"), "lengths")
    pieces = counts.selectExpr("doc_id", "words", f"explode(sequence(0L, (words - 1) div {max_len})) AS piece").selectExpr(
        "doc_id", "piece", f"piece * {max_len} AS first_word", f"least(words - piece * {max_len}, {max_len}) AS n_words"
    )
    # Groups are ranges of a hash, so a rank is the group's start plus the place inside it.
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_GROUPS * core.parts(base))))
    sizes = pieces.groupBy("n_words", "grp").agg(F.count("*").alias("n"))
    starts = sizes.select(
        "n_words", "grp", (F.sum("n").over(Window.partitionBy("n_words").orderBy("grp")) - F.col("n")).alias("start")
    )
    histogram = {r.n_words: r.n for r in sizes.groupBy("n_words").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        intervals(place(histogram, max_len)), "length bigint, lo bigint, hi bigint, pack0 bigint, slot int, pack_offset bigint"
    )
    ranked = (
        pieces.withColumn("rn", F.row_number().over(Window.partitionBy("n_words", "grp").orderBy("doc_id", "piece")))
        .join(starts, ["n_words", "grp"])
        .withColumn("rank", F.col("start") + F.col("rn") - 1)
    )
    # The places are at most a few for each of max_len lengths: bounded whatever the corpus.
    return ranked.join(
        F.broadcast(places), (F.col("n_words") == F.col("length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    ).selectExpr("pack0 + rank - lo AS pack_id", "slot", "pack_offset", "doc_id", "piece", "first_word", "n_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(core.table(spark, sf_dir, "documents"))
