"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed once and the index is stored: a shard (whole documents, about
``shard_words`` words) holds every term, how often it occurs and the sorted list of its positions.
A search reads the index and no text.  Summed over the shards, the counts of the tests' terms give
their rarity in all training texts.  A test phrase (every window of ``phrase`` words of a test text,
or the whole text if it is shorter) is then found by taking the list of its rarest term, moved back by
the term's offset, and intersecting it with the lists of its other terms, rarest first.  Windows that
follow each other on one diagonal are joined to maximal matches.  Proximity matches need no order:
``near_all`` of all terms of a test text within ``near_span`` times its length.  Any such window holds
one of the rarest terms that are too many to be all lacking, and several of a few more, which picks the
places to look at; the best window that starts at a term is reported.

The index lies in the shared folder; the tests go to each shard, and their size is checked: beyond
``slice_bytes`` they are looked up in several passes.
Cases: null or empty texts on either side match nothing; texts of any length are indexed whole; test
texts of fewer than ``least`` words are searched as a whole phrase of the kind ``short``, as they can
match by chance, and neither these nor texts of fewer than 4 different terms have proximity matches;
repeated rows are matched once for each row; equally rare terms are ordered by name, equally good windows
by place; a doc_id must be an integer or a number in text form; documents without one cannot be named and
are left out; an empty table on either side gives an empty result; other columns, of whatever name, are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

PHRASE, LEAST, NEAR_ALL, NEAR_SPAN = 13, 8, 0.6, 2
SHARD_WORDS = 1 << 20
SLICE_BYTES = 4 << 20

_WORDS = re.compile(core.WORD_SQL)
_INDEX = "doc_ids binary, doc_starts binary, terms binary, sizes binary, positions binary"
_OUT = "doc_id bigint, item_id bigint, kind string, doc_start bigint, item_start bigint, n_words bigint"


def _index(shard_words: int):
    def build(ids: list, held: list[core.Words]) -> pa.RecordBatch:
        h = np.concatenate([w.hash for w in held])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.off) for w in held]))]).astype(np.uint32)
        order = np.argsort(h, kind="stable")
        h = h[order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        cols = [np.array(ids, dtype=np.int64), starts, h[heads], np.diff(np.append(heads, len(h))).astype(np.uint32), order.astype(np.uint32)]
        return pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in cols], names=[f.split()[0] for f in _INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            for b in core.slices(batch):
                w = core.words_of(b.column("text"))
                ids += b.column("doc_id").to_pylist()
                held.append(w)
                size += len(w.hash)
                if size >= shard_words:
                    yield build(ids, held)
                    ids, held, size = [], [], 0
        if size:
            yield build(ids, held)

    return run


def _places(terms: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each term of ``vocab`` is among a shard's terms, and whether it is."""
    i = np.minimum(np.searchsorted(terms, vocab), max(len(terms) - 1, 0))
    return i, (terms[i] == vocab) if len(terms) else np.zeros(len(vocab), dtype=bool)


def _sum_sizes(vocab: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), dtype=np.int64)
        for b in batches:
            for terms, sizes in zip(b.column("terms"), b.column("sizes")):
                i, there = _places(np.frombuffer(terms.as_buffer(), np.uint64), vocab)
                total[there] += np.frombuffer(sizes.as_buffer(), np.uint32)[i[there]]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "n"])

    return run


class Lists:
    """A shard's posting lists of the tests' terms."""

    def __init__(self, vocab: np.ndarray, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray) -> None:
        i, there = _places(terms, vocab)
        start = np.cumsum(sizes.astype(np.int64)) - sizes
        sizes = np.where(there, sizes[i], 0).astype(np.int64) if len(sizes) else np.zeros(len(vocab), dtype=np.int64)
        lists = [positions[a : a + n] for a, n in zip(start[i].tolist(), sizes.tolist()) if n] if len(start) else []
        positions = np.concatenate(lists) if lists else positions[:0]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.positions = positions
        # One sorted array of (term, position) serves every membership test.
        self.keys = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | positions.astype(np.uint64)

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.at[term] : self.at[term + 1]].astype(np.int64)

    def have(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        want = terms.astype(np.uint64) << np.uint64(32) | np.maximum(positions, 0).astype(np.uint64)
        i = np.minimum(np.searchsorted(self.keys, want), max(len(self.keys) - 1, 0))
        return (self.keys[i] == want) & (positions >= 0) if len(self.keys) else np.zeros(len(want), dtype=bool)


def _between(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The members of sorted ``x`` in any of the ranges (both bounds rise)."""
    i, j = np.searchsorted(x, lo), np.searchsorted(x, hi)
    edge = np.bincount(i, minlength=len(x) + 1) - np.bincount(j, minlength=len(x) + 1)
    return x[np.cumsum(edge)[: len(x)] > 0]


def _windows(first: np.ndarray, rarity: np.ndarray, query: np.ndarray, phrase: int):
    """Start, length and the offsets of the terms, rarest first, of every phrase."""
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        n = min(phrase, z - a)
        out += [(s, n) for s in range(a, z - n + 1)] if n else []
    return [(s, n, np.argsort(rarity[query[s : s + n]], kind="stable")) for s, n in out]


def _match(items: list, first: np.ndarray, query: np.ndarray, vocab: np.ndarray, rarity: np.ndarray, p: dict):
    """``rarity``: each term's place from the rarest on."""
    windows = _windows(first, rarity, query, p["phrase"])
    short = np.diff(first) < p["least"]
    item_of = np.repeat(np.arange(len(items)), np.diff(first))

    def phrases(lists: Lists, owner: np.ndarray):
        starts, ws = [], []
        for k, (s, _, order) in enumerate(windows):
            o = int(order[0])
            got = lists.of(int(query[s + o])) - o
            if len(got):
                starts.append(got)
                ws.append(np.full(len(got), k))
        if not starts:
            return
        start, w = np.concatenate(starts), np.concatenate(ws)
        w0 = np.array([x[0] for x in windows])
        n0 = np.array([x[1] for x in windows])
        order = np.zeros((len(windows), int(n0.max())), dtype=np.int64)
        for k, x in enumerate(windows):
            order[k, : x[1]] = x[2]
        for r in range(1, order.shape[1]):
            live = r < n0[w]
            o = order[w, np.minimum(r, n0[w] - 1)]
            ok = ~live | lists.have(query[w0[w] + o], start + o)
            start, w = start[ok], w[ok]
        ok = (start >= 0) & (start + n0[w] <= len(owner))
        start, w = start[ok], w[ok]
        ok = owner[start] == owner[np.maximum(start + n0[w] - 1, 0)]
        start, w = start[ok], w[ok]
        # Windows on one diagonal of one document and item join where they overlap.
        q = w0[w]
        o = np.lexsort((q, start - q, owner[start], item_of[q]))
        start, q, n, d = start[o], q[o], n0[w][o], owner[start][o]
        if not len(start):
            return
        new = np.ones(len(start), dtype=bool)
        new[1:] = (q[1:] != q[:-1] + 1) | (start[1:] != start[:-1] + 1) | (item_of[q[1:]] != item_of[q[:-1]]) | (d[1:] != d[:-1])
        heads = np.flatnonzero(new)
        last = np.concatenate([heads[1:], [len(start)]]) - 1
        for h, z in zip(heads.tolist(), last.tolist()):
            yield int(d[h]), int(item_of[q[h]]), "short" if short[item_of[q[h]]] else "phrase", int(start[h]), int(q[h]), int(q[z] + n[z] - q[h])

    def near(lists: Lists, owner: np.ndarray, ends: np.ndarray):
        for item in range(len(items)):
            a, z = int(first[item]), int(first[item + 1])
            terms = np.unique(query[a:z])
            if z - a < p["least"] or len(terms) < 4:
                continue
            terms = terms[np.argsort(rarity[terms])]
            need, span = math.ceil(p["near_all"] * len(terms)), p["near_span"] * (z - a)
            # A match lacks at most len(terms) - need terms: of the first ``some`` it holds ``held``.
            lacking = len(terms) - need
            some = lacking + 1 + (need - 1) // 2
            held = some - lacking
            got = [lists.of(int(t)) for t in terms]
            m = np.sort(np.concatenate(got[:some]))
            if len(m) < held:
                continue
            i = np.flatnonzero(m[held - 1 :] - m[: len(m) - held + 1] < span)
            if not len(i):
                continue
            # Windows with these postings start less than a span before the last and not after the first.
            lo, hi = m[i + held - 1] - span + 1, m[i] + 1
            begin = core.distinct(np.concatenate([_between(x, lo, hi) for x in got]))
            stop = np.minimum(begin + span, ends[begin])
            share = np.zeros(len(begin), dtype=np.int64)
            for x in got:
                if len(x):
                    k = np.searchsorted(x, begin)
                    share += (k < len(x)) & (x[np.minimum(k, len(x) - 1)] < stop)
            ok = share >= need
            yield from best(item, a, begin[ok], share[ok], owner)

    def best(item: int, a: int, begin: np.ndarray, share: np.ndarray, owner: np.ndarray):
        """Of each document the window with the most terms, the first of them."""
        d = owner[begin]
        o = np.lexsort((begin, -share, d))
        d, begin, share = d[o], begin[o], share[o]
        for k in np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])).tolist() if len(d) else []:
            yield int(d[k]), item, "near", int(begin[k]), a, int(share[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*[b.column(f.split()[0]) for f in _INDEX.split(", ")]):
                ids, starts, terms, sizes, positions = (np.frombuffer(x.as_buffer(), t) for x, t in zip(row, (np.int64, np.uint32, np.uint64, np.uint32, np.uint32)))
                starts = starts.astype(np.int64)
                lists = Lists(vocab, terms, sizes, positions)
                owner = np.repeat(np.arange(len(ids)), np.diff(starts))
                ends = np.repeat(starts[1:], np.diff(starts))
                rows = [
                    (int(ids[d]), items[i], kind, s - int(starts[d]), q - int(first[i]), n)
                    for gen in (phrases(lists, owner), near(lists, owner, ends))
                    for d, i, kind, s, q, n in gen
                ]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _OUT.split(", ")])

    return run


def index(docs: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored positional index of ``docs`` (doc_id, text)."""
    docs = core.pick(docs, "doc_id", "text").where("doc_id IS NOT NULL").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return core.kept(docs.mapInArrow(core.lean(_index(shard_words)), _INDEX), "index")


def search(
    shards: DataFrame, tests: DataFrame, *, phrase: int = PHRASE, least: int = LEAST, near_all: float = NEAR_ALL, near_span: int = NEAR_SPAN, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Exact and proximity matches of ``tests`` (item_id, text) in an ``index``; no text of a document is read.

    (doc_id, item_id, kind, doc_start, item_start, n_words): ``n_words`` is the length of an exact match and the
    number of different terms of a near one.
    """
    spark = shards.sparkSession
    tests = core.pick(tests, "item_id", "text").where("text IS NOT NULL")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    passes = max(1, math.ceil(size / slice_bytes))
    p = {"phrase": phrase, "least": least, "near_all": near_all, "near_span": near_span}
    out = spark.createDataFrame([], _OUT)
    for k in range(passes):
        part = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toArrow().combine_chunks()
        text = part.column("text")
        words = core.words_of(pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string()))
        vocab, query = np.unique(words.hash, return_inverse=True)
        if not len(vocab):
            continue
        sizes = shards.select("terms", "sizes").mapInArrow(core.lean(_sum_sizes(vocab)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
        total = np.zeros(len(vocab), dtype=np.int64)
        for r in sizes:
            total[r.term] = r.n
        strings = [x for t in text.to_pylist() for x in _WORDS.findall(t.lower())]
        name = np.empty(len(vocab), dtype=object)
        name[query] = strings
        rarity = np.empty(len(vocab), dtype=np.int64)
        rarity[sorted(range(len(vocab)), key=lambda i: (total[i], name[i]))] = np.arange(len(vocab))
        found = shards.mapInArrow(core.lean(_match(part.column("item_id").to_pylist(), words.off, query.astype(np.int64), vocab, rarity, p)), _OUT)
        out = found if k == 0 else out.unionByName(found)
    return out


def matches(docs: DataFrame, tests: DataFrame, *, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """``search`` of ``tests`` in a fresh ``index`` of ``docs``."""
    return search(index(docs, shard_words=shard_words), tests, **options)


def contaminated(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """(doc_id) of the documents with an exact or proximity match; whole short test texts don't count."""
    return matches(docs, tests, **options).where("kind <> 'short'").select("doc_id").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(core.table(spark, sf_dir, "documents"), core.table(spark, sf_dir, "benchmark"))


# Every term of every document and item, joined on the term; runs of one diagonal are phrases.
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM
    (SELECT doc_id, regexp_extract_all(lower(text), '{core.WORD_SQL}') AS w FROM documents WHERE doc_id IS NOT NULL)),
b0 AS MATERIALIZED (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '{core.WORD_SQL}') AS w FROM benchmark) WHERE len(w) > 0),
b AS MATERIALIZED (SELECT item_id, n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS q FROM b0),
hit AS (SELECT d.doc_id, b.item_id, b.n, d.p, b.q, d.p - b.q AS diag FROM d JOIN b USING (t)),
island AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY p) AS g FROM hit),
phrases AS (SELECT doc_id, item_id, CASE WHEN n < {LEAST} THEN 'short' ELSE 'phrase' END AS kind, min(p) AS doc_start, min(q) AS item_start, count(*) AS n_words FROM island
  GROUP BY doc_id, item_id, diag, g, n HAVING count(*) >= least({PHRASE}, n)),
term AS (SELECT DISTINCT item_id, n, t, count(DISTINCT t) OVER (PARTITION BY item_id) AS nt FROM b WHERE n >= {LEAST}),
place AS MATERIALIZED (SELECT d.doc_id, term.item_id, n, nt, d.t, d.p FROM d JOIN term USING (t) WHERE nt >= 4),
pair AS (SELECT doc_id, item_id FROM place GROUP BY doc_id, item_id, nt HAVING count(DISTINCT t) >= ceil({NEAR_ALL} * nt)),
likely AS MATERIALIZED (SELECT place.* FROM place JOIN pair USING (doc_id, item_id)),
share AS (SELECT a.item_id, a.doc_id, a.p, count(DISTINCT x.t) AS s FROM likely a JOIN likely x ON x.item_id = a.item_id AND x.doc_id = a.doc_id AND x.p >= a.p AND x.p < a.p + {NEAR_SPAN} * a.n
  GROUP BY a.item_id, a.doc_id, a.p, a.nt HAVING count(DISTINCT x.t) >= ceil({NEAR_ALL} * a.nt)),
near AS (SELECT doc_id, item_id, p, s FROM share QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY s DESC, p) = 1)
SELECT doc_id, item_id, kind, CAST(doc_start AS BIGINT) AS doc_start, CAST(item_start AS BIGINT) AS item_start, CAST(n_words AS BIGINT) AS n_words FROM phrases
UNION ALL SELECT doc_id, item_id, 'near', CAST(p AS BIGINT), 0, CAST(s AS BIGINT) FROM near
"""

