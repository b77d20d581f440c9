"""Substring dedup by recompression: spans of words that repeat anywhere in the corpus.

Every text becomes a string of symbols, at first its words.  A round replaces runs of one symbol and
then pairs (a, b), where this round's coin calls a "left" and b "right", by new symbols.  A symbol's
name is a 64-bit hash of what it stands for, so all executors name runs and pairs alike in every round
without having to meet, and equal passages have equal symbols inside; a Spark round for each would move
the whole text again, several times the input.  Symbols of ``frozen`` words or more stay as they are;
after the rounds a text is a string of symbols of about 8 to 15 words, and a segment of these, named by
all its symbols, is the highest level: a segment that occurs twice verifies all its windows at once.

1. Symbols, and *segments* (the symbols that hold all windows of ``least`` words that start in one
   symbol), are counted over the corpus.
2. Every window in a segment that occurs twice is a repeat, so the symbols have verified it.  For each
   symbol we know the words that its existence depends on.  A window that holds all of these for a
   symbol that occurs once cannot repeat.
3. The windows left over (at the ends of repeats, and where no symbol decides) are compared by their
   own hashes, together with those of one segment of each kind that repeats.

So the result is exact up to 64-bit hashes, whatever the texts: all maximal spans of which every window of ``least``
words occurs at least twice.  Cases: null and empty texts and texts of fewer than ``least`` words
have no spans; rows without a doc_id are left out; repeated rows of one doc_id and text count once;
several texts of one doc_id are reported each; a passage that overlaps its own repeat counts; texts of
any length are read whole; a doc_id must be an integer or a number in text form; an empty table gives an
empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

LEAST = 50
FROZEN = 8
ROUNDS = 12

_U = np.uint64
_ROWS = "bucket int, kind int, name bigint, doc_id bigint, payload binary, text string"
_SENT = "kind int, bucket int, payload binary"
_SPANS = "doc_id bigint, start_word bigint, n_words bigint"


class Symbols:
    """Symbols of several texts: ``begin``/``end`` in words, and the words each depends on."""

    __slots__ = ("name", "begin", "end", "low", "high", "doc")

    def __init__(self, name, begin, end, low, high, doc) -> None:
        self.name, self.begin, self.end, self.low, self.high, self.doc = name, begin, end, low, high, doc


def _runs(s: Symbols, words: np.ndarray, frozen: int) -> Symbols:
    """Replace every run of a symbol that isn't frozen, from its left, by blocks of under twice ``frozen`` words."""
    n = len(s.name)
    size = s.end - s.begin
    live = size < frozen
    same = (s.name[1:] == s.name[:-1]) & (s.doc[1:] == s.doc[:-1]) & live[1:]
    head = np.concatenate([[True], ~same])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [n]]) - 1
    few = len(first) == n
    low, high = (s.low, s.high) if few else (np.minimum.reduceat(s.low, first), np.maximum.reduceat(s.high, first))
    # A run (of one or more) depends on the word beside it, which tells that it ends there; only if
    # that word is as a repetition would have it, on all that the neighbour depends on.
    begin, end = s.begin[first], s.end[last]
    side = np.maximum(first - 1, 0)
    twin = (first > 0) & (s.doc[side] == s.doc[first]) & (words[np.maximum(begin - 1, 0)] == words[s.end[first] - 1])
    low = np.where(live[first], np.minimum(low, np.where(twin, np.minimum(s.low[side], begin - 1), begin - 1)), low)
    side = np.minimum(last + 1, n - 1)
    twin = (last < n - 1) & (s.doc[side] == s.doc[last]) & (words[np.minimum(end, len(words) - 1)] == words[s.begin[last]])
    high = np.where(live[first], np.maximum(high, np.where(twin, np.maximum(s.high[side], end + 1), end + 1)), high)
    if few:
        return Symbols(s.name, s.begin, s.end, low, high, s.doc)
    run = np.cumsum(head) - 1
    per = np.maximum((2 * frozen - 1) // size[first], 1)
    block = (np.arange(n) - first[run]) % per[run] == 0
    start = np.flatnonzero(block)
    stop = np.concatenate([start[1:], [n]])
    count = stop - start
    long = count > 1
    name = s.name[start].copy()
    name[long] = core.mix(name[long] * _U(0x9E3779B97F4A7C15) + count[long].astype(_U))
    return Symbols(name, s.begin[start], s.end[stop - 1], low[run[start]], high[run[start]], s.doc[start])


def _pairs(s: Symbols, frozen: int, round_: int) -> Symbols:
    n = len(s.name)
    live = s.end - s.begin < frozen
    coin = (core.mix(s.name + _U(round_ * 0x9E3779B9 + 1)) & _U(1)).astype(bool)
    left, right = live & coin, live & ~coin
    near = s.doc[1:] == s.doc[:-1]
    join = left[:-1] & right[1:] & near
    low, high = s.low.copy(), s.high.copy()
    # What stays alone had to see the neighbour that it could have joined.
    alone = np.flatnonzero(left[:-1] & near & ~join)
    high[alone] = np.maximum(high[alone], s.high[alone + 1])
    edge = np.flatnonzero(left & np.concatenate([~near, [True]]))
    high[edge] = np.maximum(high[edge], s.end[edge] + 1)
    alone = np.flatnonzero(right[1:] & near & ~join) + 1
    low[alone] = np.minimum(low[alone], s.low[alone - 1])
    edge = np.flatnonzero(right & np.concatenate([[True], ~near]))
    low[edge] = np.minimum(low[edge], s.begin[edge] - 1)
    gone = np.concatenate([[False], join])
    keep = np.flatnonzero(~gone)
    joined = np.concatenate([join, [False]])[keep]
    other = np.minimum(keep + 1, n - 1)
    name = np.where(joined, core.mix(s.name[keep] * _U(0xC2B2AE3D27D4EB4F) + core.mix(s.name[other])), s.name[keep])
    end = np.where(joined, s.end[other], s.end[keep])
    return Symbols(
        name, s.begin[keep], end, np.where(joined, np.minimum(low[keep], low[other]), low[keep]),
        np.where(joined, np.maximum(high[keep], high[other]), high[keep]), s.doc[keep],
    )


def parse(w: core.Words, frozen: int = FROZEN, rounds: int = ROUNDS) -> Symbols:
    at = np.arange(len(w.hash), dtype=np.int64)
    s = Symbols(w.hash, at, at + 1, at, at + 1, w.doc)
    for r in range(rounds):
        if not len(s.name):
            break
        s = _pairs(_runs(s, w.hash, frozen), frozen, r)
    return s


def segments(s: Symbols, off: np.ndarray, least: int) -> np.ndarray:
    """A name of the symbols that hold the windows starting in each symbol."""
    n = len(s.name)
    last = np.searchsorted(s.end, np.minimum(s.end - 1 + least, off[s.doc + 1]))  # the first symbol that ends there or later
    last = np.minimum(last, n - 1)
    up, down = core._GRAMS.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(s.name * up[:n], out=total[1:])
    i = np.arange(n)
    return core.mix((total[last + 1] - total[i]) * down[:n] + (last + 1 - i).astype(_U))


def _named(batch: pa.RecordBatch, least: int) -> Iterator[tuple[pa.RecordBatch, core.Words, Symbols]]:
    for b in core.slices(batch):
        w = core.words_of(b.column("text"))
        if len(w.hash):
            yield b, w, parse(w)


def _count_rows(least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = core.Packer(buckets)
        for batch in batches:
            for b, w, s in _named(batch, least):
                size = np.diff(w.off)
                ok = size[s.doc] >= least
                node = np.asarray(b.column("name"))[s.doc]
                pos = (s.begin - w.off[s.doc]).astype(np.uint32)
                seg = segments(s, w.off, least) | _U(1)
                fits = ok & (s.begin + least <= w.off[s.doc + 1])
                name = s.name & ~_U(1)
                yield from packer.add(name[ok], name[ok], node[ok], pos[ok])
                yield from packer.add(seg[fits], seg[fits], node[fits], pos[fits])
        yield from packer.flush()

    return run


def _shared(buckets: int):
    """What occurs twice or more, back to its text: 1 symbol, 2 segment, 3 the first segment of its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, node, pos = core.unpack(core.payloads(batches), ["u8", "i8", "u4"])
        if not len(h):
            return
        o = np.lexsort((pos, node, h))
        h, node, pos = h[o], node[o], pos[o]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1]) | (pos[1:] != pos[:-1])
        h, node, pos = h[new], node[new], pos[new]
        head = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.flatnonzero(head)
        n = np.diff(np.concatenate([first, [len(h)]]))
        kind = np.where(h & _U(1), 2 + head, 1).astype(np.uint8)
        keep = np.repeat(n >= 2, n)
        packer = core.Packer(buckets)
        yield from packer.add(node[keep].view(np.uint64), node[keep], pos[keep], kind[keep])
        yield from packer.flush()

    return run


def _with_bucket(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            bucket = core.buckets_of(np.asarray(b.column("name")).view(np.uint64), buckets)
            cols = [pa.array(bucket), pa.array(np.ones(n, dtype=np.int32)), b.column("name"), b.column("doc_id"), pa.nulls(n, pa.binary()), b.column("text")]
            yield pa.record_batch(cols, names=[f.split()[0] for f in _ROWS.split(", ")])

    return run


def _islands(at: np.ndarray, brk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every stretch; ``brk[i]`` is between i and i + 1."""
    first = np.flatnonzero(np.concatenate([[True], brk])) if len(at) else np.zeros(0, dtype=np.int64)
    return first, np.concatenate([first[1:], [len(at)]]) - 1 if len(at) else first


def _windows(least: int, buckets: int):
    """Stretches that segments have verified (kind 1) and the windows to compare (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, texts = [], []
        for b in batches:
            kind = np.asarray(b.column("kind"))
            if (kind == 0).any():
                flags += b.filter(pa.array(kind == 0)).column("payload").to_pylist()
            if (kind == 1).any():
                texts.append(b.filter(pa.array(kind == 1)).select(["name", "doc_id", "text"]))
        fnode, fpos, fkind = core.unpack(flags, ["i8", "u4", "u1"])
        o = np.lexsort((fpos, fnode))
        fnode, fpos, fkind = fnode[o], fpos[o].astype(np.int64), fkind[o]
        known = core.distinct(fnode)
        done: set[int] = set()
        windows, stretches = core.Packer(buckets), core.Packer(buckets)

        def tagged(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p in batches:
                yield pa.record_batch([pa.array(np.full(p.num_rows, kind, dtype=np.int32)), *p.columns], names=["kind", "bucket", "payload"])

        for t in texts:
            take = [i for i, n in enumerate(t.column("name").to_pylist()) if n not in done and not done.add(n)]
            t = t.take(pa.array(take, pa.int64()))
            for b, w, s in _named(t, least):
                size = np.diff(w.off)
                name = np.asarray(b.column("name"))
                doc_id = np.asarray(b.column("doc_id"))
                n = len(w.hash)
                # Where this slice's symbols have flags.
                sym, seg, rep = (np.zeros(len(s.name), dtype=bool) for _ in range(3))
                lo = np.searchsorted(fnode, name)
                hi = np.searchsorted(fnode, name, side="right")
                if len(known) and (hi > lo).any():
                    ix = np.concatenate([np.arange(a, z) for a, z in zip(lo.tolist(), hi.tolist())])
                    word = fpos[ix] + np.repeat(w.off[:-1], hi - lo)
                    at = np.searchsorted(s.begin, word)
                    k = fkind[ix]
                    sym[at[k == 1]] = True
                    seg[at[k >= 2]] = True
                    rep[at[k == 3]] = True
                # A symbol that occurs once rules out every window that holds what it depends on.
                dead = np.zeros(n + 1, dtype=np.int64)
                alone = np.flatnonzero(~sym & (s.high - s.low <= least) & (size[s.doc] >= least))
                a, z = np.maximum(s.high[alone] - least, w.off[s.doc[alone]]), s.low[alone] + 1
                np.add.at(dead, a, 1)
                np.add.at(dead, z, -1)
                fits = w.room >= least
                of = np.repeat(np.arange(len(s.name)), s.end - s.begin)
                sure = seg[of] & fits
                test = fits & (np.where(seg[of], rep[of], np.cumsum(dead[:-1]) == 0))
                d = w.doc
                at = np.flatnonzero(test)
                if len(at):
                    g = core.grams(w, least)[at]
                    local = (at - w.off[d[at]]).astype(np.uint32)
                    yield from tagged(0, windows.add(g, g, name[d[at]], local, sure[at].astype(np.uint8)))
                at = np.flatnonzero(sure)
                first, last = _islands(at, (np.diff(at) != 1) | (np.diff(d[at]) != 0))
                begin, end = at[first], at[last]
                dd = d[begin]
                some = np.unique(d[test & ~sure])  # so that these texts' doc_ids are known in the end
                node = np.concatenate([name[dd], name[some]])
                yield from tagged(1, stretches.add(
                    node.view(np.uint64), node, np.concatenate([doc_id[dd], doc_id[some]]),
                    np.concatenate([begin - w.off[dd], np.ones(len(some), dtype=np.int64)]), np.concatenate([end - w.off[dd], np.zeros(len(some), dtype=np.int64)]),
                ))
        yield from tagged(0, windows.flush())
        yield from tagged(1, stretches.flush())

    return run


def _equal(buckets: int):
    """Windows that equal another one, joined to stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, node, pos, sure = core.unpack(core.payloads(batches), ["u8", "i8", "u4", "u1"])
        if not len(h):
            return
        o = np.argsort(h, kind="stable")
        h, node, pos, sure = h[o], node[o], pos[o].astype(np.int64), sure[o]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([first, [len(h)]]))
        keep = np.repeat(n >= 2, n) & (sure == 0)
        node, pos = node[keep], pos[keep]
        packer = core.Packer(buckets)
        yield from packer.add(node.view(np.uint64), node, np.zeros(len(node), dtype=np.int64), pos, pos)
        yield from packer.flush()

    return run


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, doc, lo, hi = core.unpack(core.payloads(batches), ["i8", "i8", "i8", "i8"])
        if not len(node):
            return
        # Rows of a text that come from its own task carry its doc_id; those of single windows have 0 there.
        own = np.flatnonzero((doc != 0) | (lo > hi))
        names, at = np.unique(node[own], return_index=True)
        ids = doc[own][at]
        real = lo <= hi
        node, lo, hi = node[real], lo[real], hi[real]
        if not len(node):
            return
        o = np.lexsort((hi, lo, node))
        node, lo, hi = node[o], lo[o], hi[o]
        # Stretches of one text are few and sorted: a running maximum joins those that touch spans.
        width = int(hi.max()) + least + 2
        rank = np.cumsum(np.concatenate([[0], (node[1:] != node[:-1]).astype(np.int64)]))
        reach = np.maximum.accumulate(rank * width + hi)
        cut = (rank[1:] * width + lo[1:] > reach[:-1] + 1) | (rank[1:] != rank[:-1])
        first = np.flatnonzero(np.concatenate([[True], cut]))
        last = np.concatenate([first[1:], [len(node)]]) - 1
        end = reach[last] - rank[last] * width
        i = np.minimum(np.searchsorted(names, node[first]), max(len(names) - 1, 0))
        ids = np.where(names[i] == node[first], ids[i], 0) if len(names) else np.zeros(len(first), dtype=np.int64)
        yield pa.record_batch([pa.array(ids), pa.array(lo[first]), pa.array(end - lo[first] + least)], names=[f.split()[0] for f in _SPANS.split(", ")])

    return run


def repeated_spans(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(doc_id, start_word, n_words): maximal runs of windows of ``least`` words that occur twice or more."""
    if least < 2:
        raise ValueError("least must be at least 2")
    p = core.parts(docs)
    base = core.pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr(
        "xxhash64(CAST(doc_id AS BIGINT), text) AS name", "CAST(doc_id AS BIGINT) AS doc_id", "text"
    )
    counted = core.spread(base.select("name", "text").mapInArrow(core.lean(_count_rows(least, p)), core.PACKED), p)
    none = "CAST(NULL AS BIGINT)"
    flags = counted.mapInArrow(core.lean(_shared(p)), core.PACKED).selectExpr(
        "bucket", "0 AS kind", f"{none} AS name", f"{none} AS doc_id", "payload", "CAST(NULL AS STRING) AS text"
    )
    rows = base.mapInArrow(core.lean(_with_bucket(p)), _ROWS).unionByName(flags)
    sent = core.kept(core.spread(rows, p).mapInArrow(core.lean(_windows(least, p)), _SENT), "windows")
    equal = core.spread(sent.where("kind = 0").select("bucket", "payload"), p).mapInArrow(core.lean(_equal(p)), core.PACKED)
    every = sent.where("kind = 1").select("bucket", "payload").unionByName(equal)
    return core.spread(every, p).mapInArrow(core.lean(_merge(least)), _SPANS).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(core.table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(lower(text), '{core.WORD_SQL}') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
g AS (SELECT doc_id, k, unnest(list_transform(range(1, len(w) - {LEAST - 2}), lambda i: {{'p': i - 1, 'h': hash(array_to_string(w[i:i + {LEAST - 1}], ' '))}}), recursive := true) FROM w WHERE len(w) >= {LEAST}),
r AS (SELECT doc_id, k, p FROM g QUALIFY count(*) OVER (PARTITION BY h) >= 2),
i AS (SELECT doc_id, k, p, p - row_number() OVER (PARTITION BY doc_id, k ORDER BY p) AS island FROM r)
SELECT DISTINCT doc_id, CAST(min(p) AS BIGINT) AS start_word, CAST(max(p) - min(p) + {LEAST} AS BIGINT) AS n_words FROM i GROUP BY doc_id, k, island
"""
