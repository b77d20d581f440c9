"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams (``GRAMS`` lengths, inside lower-cased text whose other signs are
blanks), present or absent, hashed to ``1 << BITS`` numbers.  From labelled texts, at most
``max_labelled`` of each class chosen by a hash of their doc_id, we take for every feature the
log-count ratio r = ln((p / sum p) / (q / sum q)), where p and q count (plus one) the toxic and the
other texts that have it.  Features stay that ``min_texts`` texts have and whose ratio is at least
``least_sure`` of its standard deviations from 0, however many these are.  A logistic regression is fitted on r times presence; weight times r is then one number for each
feature, so scoring is one pass over all texts, which are read whole, without any exchange.

``max_labelled`` bounds the fit only, to so many labels and so many texts of each class; every document is
scored, in whole.  The model has at most ``1 << BITS`` weights.
A text without any feature takes part in the fit as one that isn't toxic, of weight ``EMPTY`` (each class has 0.5).
Cases: a null or empty text has no features and gets the intercept's score; texts of any length are read
whole; labels that are null are ignored, several labels of one doc_id each count, as does each different
text of one doc_id; equally good features all stay; repeated documents are each scored; a null doc_id
stays null; with no labels of one of the classes nothing can be learnt: scores are null and ``is_toxic``
is false; an empty table gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

GRAMS = (3, 4, 5, 6)
BITS = 20
MAX_LABELLED = 2000
LEAST_SURE = 1.5
MIN_TEXTS = 4
#: Weight of the squared weights beside the mean loss of ``n`` texts, times n.
PENALTY = 0.01
EMPTY = 0.05
FIT_TEXTS = 256  # at once
#: Bytes of text at once: every sign has several n-grams.
SLICE_BYTES = 1 << 18
THRESHOLD = 0.6

_MODEL = "feature bigint, weight double"
_U = np.uint64


def grams_of(texts: pa.Array, sizes: tuple[int, ...] = GRAMS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: hashed n-grams at every place, and the text that each begins in (-1: in none)."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    n = len(texts)
    length = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    # Texts are set apart by blanks, so that words at their ends look like any other.
    glued = "".join(f" {t} " for t in texts.to_pylist())
    c = np.frombuffer(glued.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where((c >= 128) | ((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57)), c, 32).astype(np.uint64)
    doc = np.repeat(np.arange(n), length + 2)
    h, size = c, 1
    for m in range(2, max(sizes) + 1):
        if len(c) < m:
            return
        h = h[: len(c) - m + 1] * _U(0x9E3779B97F4A7C15) + c[m - 1 :]
        size = m
        if size in sizes:
            key = (core.mix(h + _U(size)) >> _U(64 - bits)).astype(np.int64)
            first, last = doc[: len(key)], doc[m - 1 :]
            yield key, np.where(first == last, first, -1)


def _features(sizes: tuple[int, ...], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in core.slices(batch, limit=SLICE_BYTES):
                found = [d * (1 << bits) + k for k, d in ((k[d >= 0], d[d >= 0]) for k, d in grams_of(b.column("text"), sizes, bits))]
                keys = core.distinct(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
                edge = np.searchsorted(keys, np.arange(b.num_rows + 1) << bits)
                low = (keys & ((1 << bits) - 1)).astype(np.uint32)
                body = [low[i:j].tobytes() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
                yield pa.record_batch([b.column("toxic"), pa.array(body, pa.binary())], names=["toxic", "body"])

    return run


def fit(rows: list[np.ndarray], toxic: np.ndarray, bits: int, least_sure: float, min_texts: int, penalty: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(features, weights times ratios, intercept) of texts given by their features; uses up ``rows``."""
    if not toxic.any() or toxic.all():
        return None
    # A text's features are distinct, so counts grow row by row and no joined copy is held.
    p, q = np.zeros(1 << bits), np.zeros(1 << bits)
    for ids, bad in zip(rows, toxic.tolist()):
        (p if bad else q)[ids] += 1
    r = np.log((p + 1.0) / (p + 1.0).sum()) - np.log((q + 1.0) / (q + 1.0).sum())
    sure = np.abs(r) / np.sqrt(1 / (p + 1.0) + 1 / (q + 1.0))
    sure[p + q < min_texts] = 0
    chosen = np.flatnonzero(sure >= least_sure)
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    n, y = len(rows), toxic.astype(np.float64)
    # Places of the chosen features, text by text; nothing else grows with them.
    for k, ids in enumerate(rows):
        c = place[ids]
        rows[k] = c[c >= 0]
    count = np.array([len(c) for c in rows])
    col = np.concatenate(rows)
    rows.clear()
    edge = np.concatenate([[0], np.cumsum(count)])
    cuts = [*range(0, n, FIT_TEXTS), n]
    ratio = r[chosen]
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())  # both classes weigh alike

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        w, b, f = v[:-1], v[-1], 0.0
        weight, down, slope = ratio * w, np.zeros(len(w)), 0.0
        for i, j in zip(cuts, cuts[1:]):
            mine = col[edge[i] : edge[j]]
            z = np.full(j - i, b) + np.bincount(np.repeat(np.arange(j - i), count[i:j]), weight[mine], j - i)
            g = share[i:j] * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[i:j])
            down += np.bincount(mine, np.repeat(g, count[i:j]), len(w))
            slope += g.sum()
            f += float((share[i:j] * (np.logaddexp(0, z) - y[i:j] * z)).sum())
        empty = EMPTY / (1 + np.exp(-np.clip(b, -500, 500)))
        f += EMPTY * np.logaddexp(0, b) + penalty / n / 2 * (w @ w)
        return f, np.append(ratio * down + penalty / n * w, slope + empty)

    v = minimum(loss, np.zeros(len(chosen) + 1))
    return chosen, v[:-1] * ratio, float(v[-1])


def minimum(loss, v: np.ndarray, *, steps: int = 200, memory: int = 10, close: float = 1e-6) -> np.ndarray:
    """Where a smooth convex function (value and gradient) is least, by limited-memory BFGS."""
    f, g = loss(v)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max() < close:
            break
        d, back = -g, []
        for s, t, k in reversed(moves):
            a = k * (s @ d)
            back.append(a)
            d = d - a * t
        if moves:
            s, t, k = moves[-1]
            d = d / (k * (t @ t))
        for (s, t, k), a in zip(moves, reversed(back)):
            d = d + (a - k * (t @ d)) * s
        size, slope = 1.0 if moves else 1.0 / max(1.0, float(np.abs(g).sum())), float(g @ d)
        while True:
            now = v + size * d
            value, down = loss(now)
            if value <= f + 1e-4 * size * slope or size < 1e-12:
                break
            size /= 2
        s, t = now - v, down - g
        if s @ t > 1e-18:
            moves = [*moves[1 - memory :], (s, t, 1.0 / float(s @ t))]
        v, f, g = now, value, down
    return v


def _fit_rows(bits: int, least_sure: float, min_texts: int, penalty: float):
    """The model as rows; feature -1 is the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = [], []
        for b in batches:
            rows += [np.frombuffer(x, np.uint32) for x in b.column("body").to_pylist()]
            toxic += b.column("toxic").to_pylist()
        got = fit(rows, np.array(toxic, dtype=np.int64) > 0, bits, least_sure, min_texts, penalty) if rows else None
        if got is not None:
            yield pa.record_batch([pa.array(np.concatenate([[-1], got[0]])), pa.array(np.concatenate([[got[2]], got[1]]))], names=["feature", "weight"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, sizes: tuple[int, ...] = GRAMS, bits: int = BITS,
    least_sure: float = LEAST_SURE, min_texts: int = MIN_TEXTS, penalty: float = PENALTY,
) -> tuple[np.ndarray, float] | None:
    """(weight of each feature, intercept), or None where there is nothing to learn."""
    docs = core.pick(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    known = core.pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").selectExpr("doc_id", "CAST(toxic > 0 AS INT) AS toxic")
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*by).limit(max_labelled).unionByName(known.where("toxic = 0").orderBy(*by).limit(max_labelled))
    # At most twice max_labelled rows of two numbers: small whatever the tables.
    some = some.groupBy("doc_id", "toxic").agg(F.count("*").alias("n"))
    # Each text of a labelled doc_id, and so many of them at most: a doc_id can have any number.
    found = docs.join(F.broadcast(some), "doc_id").distinct()
    by = [F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text")]
    texts = found.where("toxic = 1").orderBy(*by).limit(max_labelled).unionByName(found.where("toxic = 0").orderBy(*by).limit(max_labelled))
    each = texts.selectExpr("toxic", "text", "explode(sequence(1L, n)) AS k").select("toxic", "text")
    # The limits leave the texts in one partition each; their features are made by all.
    model = each.repartition(core.parts(docs)).mapInArrow(core.lean(_features(sizes, bits)), "toxic int, body binary").repartition(1).sortWithinPartitions("toxic", "body")
    got = model.mapInArrow(core.lean(_fit_rows(bits, least_sure, min_texts, penalty)), _MODEL).toArrow()
    if not got.num_rows:
        return None
    feature, weight = np.asarray(got.column("feature").combine_chunks()), np.asarray(got.column("weight").combine_chunks())
    table = np.zeros(1 << bits)
    table[feature[feature >= 0]] = weight[feature >= 0]
    return table, float(weight[feature < 0][0])


def _score(weights: np.ndarray, intercept: float, sizes: tuple[int, ...], bits: int):
    used = weights != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in core.slices(batch, limit=SLICE_BYTES):
                total = np.full(b.num_rows, intercept)
                found = []
                for key, doc in grams_of(b.column("text"), sizes, bits):
                    at = np.flatnonzero(used[key] & (doc >= 0))
                    found.append(doc[at] * (1 << bits) + key[at])
                if found:
                    k = core.distinct(np.concatenate(found))
                    total += np.bincount(k >> bits, weights[k & ((1 << bits) - 1)], b.num_rows)
                p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.record_batch([b.column("doc_id"), pa.array(p)], names=["doc_id", "toxicity"])

    return run


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sizes: tuple[int, ...] = GRAMS, bits: int = BITS, **options) -> DataFrame:
    """(doc_id, toxicity, is_toxic) of every document, by a model trained on ``labels`` (doc_id, toxic)."""
    model = train(docs, labels, sizes=sizes, bits=bits, **options)
    base = core.pick(docs, "doc_id", "text")
    if model is None:
        return base.selectExpr("doc_id", "CAST(NULL AS DOUBLE) AS toxicity", "false AS is_toxic")
    kind = base.schema["doc_id"].dataType.simpleString()
    scored = base.mapInArrow(core.lean(_score(*model, sizes, bits)), f"doc_id {kind}, toxicity double")
    return scored.select("doc_id", "toxicity", (F.col("toxicity") >= threshold).alias("is_toxic"))


def _kept_rows(weights: np.ndarray, intercept: float, sizes: tuple[int, ...], bits: int, threshold: float, where: int):
    scored = _score(weights, intercept, sizes, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbered = pa.record_batch([pa.array(range(batch.num_rows), pa.int64()), batch.column(where)], names=["doc_id", "text"])
            # Parts come in order, however the texts are sliced.
            p = np.concatenate([np.asarray(part.column("toxicity")) for part in scored([numbered])])
            yield batch.filter(pa.array(p < threshold))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sizes: tuple[int, ...] = GRAMS, bits: int = BITS, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier doesn't reject."""
    model = train(docs, labels, sizes=sizes, bits=bits, **options)
    if model is None:
        return docs
    return docs.mapInArrow(core.lean(_kept_rows(*model, sizes, bits, threshold, docs.columns.index("text"))), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "labels"))
