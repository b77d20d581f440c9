"""Maximal repeats of at least ``least`` words, with all their occurrences.

A maximal repeat is a string of words that occurs at least twice and that no single word on either
side extends at all its occurrences.  Suffixes that share their first ``least`` words form one
subtree of the common-prefix interval tree over the corpus' enhanced suffix array, so the array is
built subtree by subtree, and only where a maximal repeat can start:

1. Winnowing picks anchors (the least hash of every window of ``least - gram + 1`` grams of ``gram``
   words), so every repeat of ``least`` words holds an anchor at the same place in all occurrences.
2. Anchors that occur once are dropped.  Where all occurrences of an anchor come after the same text
   since the previous anchor, nothing can start in between; only the other places go on.
3. These places' ``least``-grams are grouped; groups whose left words are all alike extend to the
   left and are dropped (a text's start differs from everything).
4. What is left are the subtrees' roots.  Their suffixes (up to where the text stops repeating) are
   sorted, neighbours' common prefixes computed, and a stack scan walks the interval tree, writing
   each interval whose occurrences have different left words.

The result is the tree itself, which holds every occurrence of every repeat in space that grows with
the suffixes: a repeat is a stretch of places of its root's suffix array, and an occurrence is listed
with the longest repeat that has it.  ``occurrences`` expands this to all pairs of repeat and
occurrence, of which nested repeats have quadratically many.

Words are compared by 64-bit hashes, and texts are the same where their 64-bit hashes are.  Copies of
one text are one text with several doc_ids.  Cases: null and empty texts and texts of fewer than
``least`` words have no repeats; texts of any length are sorted, long self-repeating ones by doubling;
rows without a doc_id are left out; a doc_id must be an integer or a number in text form; repeated rows
of one doc_id count once; equal suffixes are in order of doc_id and place; an empty table gives an empty
result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

LEAST = 50

_U = np.uint64
_ROWS = "bucket int, kind int, name bigint, doc_id bigint, payload binary, text string"
_REGION = "region bigint, name bigint, doc_ids binary, words bigint, begin bigint, tokens binary, starts binary"
_OUT = "repeat_id bigint, n_words bigint, n_occurrences bigint, doc_id bigint, start bigint, root bigint, first_place bigint, last_place bigint, place bigint"


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over every window of ``w`` (len(a) - w + 1 of them), by doubling."""
    out, size = a, 1
    while size * 2 <= w:
        out = op(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(w: core.Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that hold the least gram hash of some window, and these hashes."""
    g = core.grams(w, gram)
    if len(g) < window:
        return np.zeros(0, dtype=np.int64), g[:0]
    room = w.room
    low = _slide(g, window, np.minimum)
    low = np.where(room[: len(low)] >= gram + window - 1, low, _U(0))
    pad = np.concatenate([np.zeros(window - 1, dtype=np.uint64), low, np.zeros(window - 1, dtype=np.uint64)])
    high = _slide(pad, window, np.maximum)
    at = np.flatnonzero((high[: len(g)] == g) & (g > 0))
    return at, g[at]


def _anchor_rows(least: int, gram: int, buckets: int):
    window = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = core.Packer(buckets), set()
        for batch in batches:
            for b in core.slices(batch):
                name = np.asarray(b.column("name"))
                fresh = []
                for i, x in enumerate(name.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > 1 << 20:
                    seen.clear()
                b, name = b.take(pa.array(fresh, pa.int64())), name[fresh]
                w = core.words_of(b.column("text"))
                at, h = anchors(w, gram, window)
                if not len(at):
                    continue
                d = np.searchsorted(w.off, at, side="right") - 1
                # The text since the previous anchor of the document, as a hash; 0 where there is none.
                up, down = core._GRAMS.get(len(w.hash) + 1)
                total = np.concatenate([[_U(0)], np.cumsum(w.hash * up[: len(w.hash)])])
                link = np.zeros(len(at), dtype=np.uint64)
                link[1:] = core.mix((total[at[1:]] - total[at[:-1]]) * down[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))
                link[1:][d[1:] != d[:-1]] = 0
                yield from packer.add(h, h, name[d], (at - w.off[d]).astype(np.uint32), link)
        yield from packer.flush()

    return run


def _shared(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, name, pos, link = core.unpack(core.payloads(batches), ["u8", "i8", "u4", "u8"])
        if not len(h):
            return
        o = np.lexsort((pos, name, h))
        h, name, pos, link = h[o], name[o], pos[o], link[o]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1]) | (pos[1:] != pos[:-1])
        h, name, pos, link = h[new], name[new], pos[new], link[new]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([heads, [len(h)]]))
        low, high = np.minimum.reduceat(link, heads), np.maximum.reduceat(link, heads)
        branch = np.repeat((low != high) | (low == 0), n)
        keep = np.repeat(n >= 2, n)
        packer = core.Packer(buckets)
        name, pos, branch = name[keep], pos[keep], branch[keep]
        yield from packer.add(name.view(np.uint64), name, pos, branch.astype(np.uint8))
        yield from packer.flush()

    return run


def _with_bucket(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            bucket = core.buckets_of(np.asarray(b.column("name")).view(np.uint64), buckets)
            cols = [pa.array(bucket), pa.array(np.ones(n, dtype=np.int32)), b.column("name"), b.column("doc_id"), pa.nulls(n, pa.binary()), b.column("text")]
            yield pa.record_batch(cols, names=["bucket", "kind", "name", "doc_id", "payload", "text"])

    return run


def _regions(least: int, gram: int):
    """Distinct texts with what repeats in them: tokens of the regions and possible starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, texts = [], []
        for b in batches:
            kind = np.asarray(b.column("kind"))
            if (kind == 0).any():
                flags += b.filter(pa.array(kind == 0)).column("payload").to_pylist()
            if (kind == 1).any():
                texts.append(b.filter(pa.array(kind == 1)).select(["name", "doc_id", "text"]))
        name, pos, branch = core.unpack(flags, ["i8", "u4", "u1"])
        o = np.lexsort((pos, name))
        name, pos, branch = name[o], pos[o].astype(np.int64), branch[o].astype(bool)
        ids: dict[int, set] = {}
        for t in texts:
            for n, d in zip(t.column("name").to_pylist(), t.column("doc_id").to_pylist()):
                ids.setdefault(n, set()).add(d)
        known = core.distinct(name)
        done: set[int] = set()
        for t in texts:
            names = t.column("name").to_pylist()
            take = [i for i, n in enumerate(names) if n not in done and not done.add(n)]
            t = t.take(pa.array(take, pa.int64()))
            n = np.asarray(t.column("name"))
            hit = np.zeros(len(n), dtype=bool)
            if len(known):
                hit = known[np.minimum(np.searchsorted(known, n), len(known) - 1)] == n
            many = np.array([len(ids[x]) > 1 for x in n.tolist()], dtype=bool)
            t = t.filter(pa.array(hit | many))
            for b in core.slices(t):
                w = core.words_of(b.column("text"))
                tok = w.hash
                rows = []
                for i, x in enumerate(b.column("name").to_pylist()):
                    a, z = int(w.off[i]), int(w.off[i + 1])
                    size = z - a
                    if size < least:
                        continue
                    lo, hi = np.searchsorted(name, x), np.searchsorted(name, x, side="right")
                    at, br = pos[lo:hi], branch[lo:hi]
                    begin, end = np.maximum(at + gram - least, 0), np.minimum(at + least, size)
                    p = np.zeros(size, dtype=bool)
                    for q in at[br].tolist():
                        p[max(0, q + gram - least) : q + 1] = True
                    if len(ids[x]) > 1:
                        p[0] = True
                        begin, end = np.concatenate([[0], begin]), np.concatenate([[least], end])
                    cut = np.flatnonzero(begin[1:] > end[:-1]) + 1 if len(begin) else []
                    docs = np.array(sorted(ids[x]), dtype=np.int64).tobytes()
                    for j, k in zip([0, *cut], [*cut, len(begin)]):
                        if k <= j:
                            continue
                        s, e = int(begin[j]), int(end[j:k].max())
                        starts = np.flatnonzero(p[s : e - least + 1]) + s
                        if not len(starts):
                            continue
                        region = core.mix(np.array([(x * 1000003 + s) % (1 << 64)], dtype=np.uint64)).view(np.int64)[0]
                        rows.append((int(region), x, docs, size, s, tok[a + max(0, s - 1) : a + e].tobytes(), starts.astype(np.uint32).tobytes()))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _REGION.split(", ")])

    return run


def _start_rows(least: int, buckets: int):
    """The grams at possible starts: (gram, left word, region, place, copies, words that may follow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = core.Packer(buckets)
        for b in batches:
            for region, docs, begin, tokens, starts in zip(*[b.column(c).to_pylist() for c in ("region", "doc_ids", "begin", "tokens", "starts")]):
                at = np.frombuffer(starts, np.uint32).astype(np.int64)
                if not len(at):
                    continue
                tok = np.frombuffer(tokens, np.uint64)
                lead = 1 if begin > 0 else 0
                place = at - begin + lead
                h = core.grams(tok, least)[place]
                left = np.where(at > 0, tok[np.maximum(place - 1, 0)], _U(0))
                n = len(at)
                yield from packer.add(
                    h, h, left, np.full(n, region, dtype=np.int64), at.astype(np.uint32), (at == 0).astype(np.uint8),
                    np.full(n, len(docs) // 8, dtype=np.uint32), (len(tok) - place).astype(np.uint32),
                )
        yield from packer.flush()

    return run


def _roots(buckets: int):
    """Groups with different left words ask their regions for the suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, left, region, at, first, copies, room = core.unpack(core.payloads(batches), ["u8", "u8", "i8", "u4", "u1", "u4", "u4"])
        if not len(h):
            return
        o = np.lexsort((at, region, h))
        h, left, region, at, first, copies, room = (x[o] for x in (h, left, region, at, first, copies, room))
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.concatenate([heads, [len(h)]]))
        total = np.add.reduceat(copies.astype(np.int64), heads)
        diverse = (np.minimum.reduceat(left, heads) != np.maximum.reduceat(left, heads)) | (np.maximum.reduceat(first, heads) > 0)
        keep = (total >= 2) & diverse
        # No common prefix is longer than the second longest suffix.
        group = np.repeat(np.arange(len(heads)), n)
        by = np.lexsort((room, group))
        ends = np.cumsum(n) - 1
        second = room[by][np.maximum(ends - 1, heads)]
        limit = np.minimum(room, np.repeat(second, n))
        m = np.repeat(keep, n)
        packer = core.Packer(buckets)
        yield from packer.add(region[m].view(np.uint64), region[m], h[m], left[m], at[m], first[m], limit[m])
        yield from packer.flush()

    return run


def _region_rows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = np.asarray(b.column("region"))
            head = [np.array([x, w, s, len(d) // 8], dtype=np.int64).tobytes() + d + t for x, w, s, d, t in zip(*[b.column(c).to_pylist() for c in ("name", "words", "begin", "doc_ids", "tokens")])]
            n = b.num_rows
            yield pa.record_batch([pa.array(core.buckets_of(region.view(np.uint64), buckets)), pa.array(np.ones(n, dtype=np.int32)), pa.array(region), pa.array(head, pa.binary())], names=["bucket", "kind", "name", "payload"])

    return run


def _suffix_rows(buckets: int):
    """One row for each (gram, region): the places and the tokens that their suffixes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bodies = [], {}
        for b in batches:
            for kind, name, payload in zip(*[b.column(c).to_pylist() for c in ("kind", "name", "payload")]):
                if kind == 0:
                    asked.append(payload)
                else:
                    bodies[name] = payload
        region, h, left, at, first, limit = core.unpack(asked, ["i8", "u8", "u8", "u4", "u1", "u4"])
        if not len(h):
            return
        o = np.lexsort((at, h, region))
        region, h, left, at, first, limit = (x[o] for x in (region, h, left, at, first, limit))
        heads = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (h[1:] != h[:-1])]))
        tails = np.concatenate([heads[1:], [len(h)]])
        bucket = core.buckets_of(h[heads], buckets)
        out: tuple[list, list] = ([], [])
        size = 0
        for k, (i, j) in enumerate(zip(heads.tolist(), tails.tolist())):
            body = bodies[int(region[i])]
            name, words, begin, m = np.frombuffer(body, np.int64, 4).tolist()
            tok = np.frombuffer(body, np.uint64, offset=32 + 8 * m)
            lead = 1 if begin > 0 else 0
            place = at[i:j].astype(np.int64) - begin + lead
            stop = int((place + limit[i:j]).max())
            part = tok[int(place[0]) : stop]
            head = np.array([int(h[i].view(np.int64)), name, words, m, j - i, len(part)], dtype=np.int64).tobytes()
            out[0].append(int(bucket[k]))
            out[1].append(head + body[32 : 32 + 8 * m] + left[i:j].tobytes() + part.tobytes() + at[i:j].tobytes() + limit[i:j].astype(np.uint32).tobytes() + first[i:j].tobytes())
            size += len(out[1][-1])
            if size > 1 << 22:
                yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "payload"])
                out, size = ([], []), 0
        if out[0]:
            yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "payload"])

    return run


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of the tree; ``lcp[i]`` is between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp, -1]):
        lo = i
        while stack and stack[-1][0] > x:
            length, lo = stack.pop()
            yield length, lo, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, lo))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    at, step = 0, 64
    while at < n:
        d = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(d):
            return at + int(d[0])
        at, step = at + step, step * 4
    return n


def _by_doubling(parts: list[np.ndarray], at: np.ndarray) -> list[int]:
    """Order of the suffixes that begin at ``at`` of the joined parts, in memory that grows with the parts only."""
    size = sum(len(p) + 1 for p in parts)
    rank = np.empty(size, dtype=np.int64)
    names = np.unique(np.concatenate(parts), return_inverse=True)[1] + len(parts)
    i = 0
    for k, p in enumerate(parts):
        rank[i : i + len(p)] = names[i - k : i - k + len(p)]
        rank[i + len(p)] = k  # every part ends in a sign of its own
        i += len(p) + 1
    rank = np.unique(rank, return_inverse=True)[1]
    step = 1
    while step < size:
        key = rank * (size + 1)
        key[:-step] += rank[step:] + 1
        uniq, rank = np.unique(key, return_inverse=True)
        if len(uniq) == size:
            break
        step *= 2
    return np.argsort(rank[at], kind="stable").tolist()


#: Roots whose suffixes have more words than this in all are sorted by doubling instead of by their bytes.
SORT_WORDS = 1 << 22


def _array(sort_words: int):
    """Enhanced suffix array of a root: order, common prefixes, and what each suffix is."""

    def build(members: list[bytes]) -> tuple:
        suffix, left, first, docs, start, ends, names = [], [], [], [], [], [], []
        parts, places, size, total = [], [], 0, 0
        read = []
        for p in members:
            _, name, words, m, n, k = np.frombuffer(p, np.int64, 6).tolist()
            at = 48
            ids = np.frombuffer(p, np.int64, m, at).tolist()
            at += 8 * m
            lw = np.frombuffer(p, np.uint64, n, at).tolist()
            tok = np.frombuffer(p, np.uint64, k, at + 8 * n)
            at += 8 * (n + k)
            pos = np.frombuffer(p, np.uint32, n, at).tolist()
            lim = np.frombuffer(p, np.uint32, n, at + 4 * n).tolist()
            fs = np.frombuffer(p, np.uint8, n, at + 8 * n).tolist()
            read.append((ids, pos, words, n, lw, lim, tok, fs, name))
        # Whatever order they arrived in.
        read.sort(key=lambda r: (r[0], r[1][0], r[8]))
        for ids, pos, words, n, lw, lim, tok, fs, name in read:
            parts.append(tok)
            for i in range(n):
                o = pos[i] - pos[0]
                suffix.append(tok[o : o + lim[i]])
                places.append(size + o)
                total += lim[i]
                left.append(lw[i])
                first.append(fs[i])
                docs.append(ids)
                names.append(name)
                start.append(pos[i])
                ends.append(words - pos[i])
            size += len(tok) + 1
        if total > sort_words:
            order = _by_doubling(parts, np.array(places))
        else:
            keys = [x.astype(">u8").tobytes() for x in suffix]
            order = sorted(range(len(suffix)), key=keys.__getitem__)
            del keys
        return order, [_common(suffix[a], suffix[b]) for a, b in zip(order, order[1:])], left, first, docs, start, ends, names

    return build


def _tree(least: int, sort_words: int):
    """The scan of each root's interval tree."""
    build = _array(sort_words)

    def scan(root: int, members: list[bytes]) -> Iterator[tuple]:
        order, lcp, left, first, docs, start, ends, _ = build(members)
        # Places up to i at which the left word changes; a text's start differs from any.
        change, copies = [0], [0]
        for a, b in zip(order, order[1:]):
            change.append(change[-1] + (left[a] != left[b] or first[a] or first[b]))
        for x in order:
            copies.append(copies[-1] + len(docs[x]))

        def rows(length: int, i: int, j: int, own: list[int]) -> Iterator[tuple]:
            head = (_name(root, i, j), length, copies[j + 1] - copies[i])
            for k in own:
                for d in docs[order[k]]:
                    yield *head, d, start[order[k]], root, i, j, k

        whole = set()
        for k, x in enumerate(order):
            # Copies of a whole text, where it goes on beyond what it shares with other texts.
            if len(docs[x]) > 1 and first[x] and ends[x] >= least and ends[x] > max(lcp[max(0, k - 1) : k + 1], default=0):
                whole.add(k)
                yield from rows(ends[x], k, k, [k])
        done: list[tuple[int, int, int]] = []  # stretches that inner repeats hold, with the place of their first occurrence
        for length, i, j in intervals(lcp):
            if length < least or change[j] == change[i]:
                continue
            own, lead, at = [], [], j
            while at >= i:
                if done and done[-1][0] <= at <= done[-1][1]:
                    low, _, who = done.pop()
                    lead.append(who)
                    at = low - 1
                else:
                    (lead if at in whole else own).append(at)
                    at -= 1
            best = min(own + lead, key=lambda k: (docs[order[k]][0], start[order[k]]))
            yield from rows(length, i, j, own)
            if best in lead:  # every repeat has its first occurrence beside those that no longer repeat has
                yield _name(root, i, j), length, copies[j + 1] - copies[i], docs[order[best]][0], start[order[best]], root, i, j, best
            done.append((i, j, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[bytes]] = {}
        for p in core.payloads(batches):
            groups.setdefault(int(np.frombuffer(p, np.int64, 1)[0]), []).append(p)
        held = []
        names = [f.split()[0] for f in _OUT.split(", ")]

        def send() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held)], names=names)
            held.clear()
            return out

        for h in list(groups):
            for r in scan(h, groups.pop(h)):
                held.append(r)
                if len(held) >= 1 << 16:
                    yield send()
        if held:
            yield send()

    return run


def _name(root: int, i: int, j: int) -> int:
    """A 64-bit name of a stretch of a root's places."""
    x = (root * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F + j) & 0xFFFFFFFFFFFFFFFF
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * k) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 33
    return x - (1 << 64) if x >> 63 else x


def maximal_repeats(docs: DataFrame, *, least: int = LEAST, sort_words: int = SORT_WORDS) -> DataFrame:
    """Every maximal repeat of at least ``least`` words, with all its occurrences, as the interval tree.

    A repeat (``repeat_id``, ``n_words``, ``n_occurrences``) holds the places ``first_place`` to ``last_place`` of
    the suffix array of ``root``.  One row for each occurrence (``doc_id``, ``start`` in words, ``place``), listed
    with the longest repeat that has it; the first occurrence of a repeat is listed with it in any case.
    ``sort_words`` changes how, not what.
    """
    return core.spread(_suffixes(docs, least), core.parts(docs)).mapInArrow(core.lean(_tree(least, sort_words)), _OUT)


def occurrences(tree: DataFrame) -> DataFrame:
    """(repeat_id, n_words, doc_id, start): all occurrences of each repeat of ``maximal_repeats``, those of inner repeats too."""
    repeats = tree.select("repeat_id", "n_words", "root", "first_place", "last_place").distinct()
    places = tree.select(F.col("root").alias("of"), "place", "doc_id", "start").distinct()
    inside = (F.col("root") == F.col("of")) & F.col("place").between(F.col("first_place"), F.col("last_place"))
    return repeats.join(places, inside).select("repeat_id", "n_words", "doc_id", "start")


def _suffixes(docs: DataFrame, least: int) -> DataFrame:
    """Packed suffixes of every root."""
    if least < 2:
        raise ValueError("least must be at least 2")
    spark = docs.sparkSession
    gram = max(1, least // 2)
    p = core.parts(docs)
    base = core.pick(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr("xxhash64(text) AS name", "CAST(doc_id AS BIGINT) AS doc_id", "text")
    posted = core.spread(base.select("name", "text").mapInArrow(core.lean(_anchor_rows(least, gram, p)), core.PACKED), p)
    flags = posted.mapInArrow(core.lean(_shared(p)), core.PACKED)
    rows = base.mapInArrow(core.lean(_with_bucket(p)), _ROWS)
    none = "CAST(NULL AS BIGINT)"
    rows = rows.unionByName(flags.selectExpr("bucket", "0 AS kind", f"{none} AS name", f"{none} AS doc_id", "payload", "CAST(NULL AS STRING) AS text"))
    regions = core.kept(core.spread(rows, p).mapInArrow(core.lean(_regions(least, gram)), _REGION), "regions")
    asked = core.spread(regions.mapInArrow(core.lean(_start_rows(least, p)), core.PACKED), p).mapInArrow(core.lean(_roots(p)), core.PACKED)
    both = regions.mapInArrow(core.lean(_region_rows(p)), "bucket int, kind int, name bigint, payload binary").unionByName(
        asked.selectExpr("bucket", "0 AS kind", f"{none} AS name", "payload")
    )
    return core.spread(both, p).mapInArrow(core.lean(_suffix_rows(p)), core.PACKED)


# -- cutting repeats ---------------------------------------------------------------------------


def _joined(doc: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each text of a document, those that touch joined."""
    o = np.lexsort((lo, name, doc))
    doc, name, lo, hi = doc[o], name[o], lo[o], hi[o]
    rank = np.cumsum(np.concatenate([[0], ((doc[1:] != doc[:-1]) | (name[1:] != name[:-1])).astype(np.int64)]))
    width = int(hi.max()) + 2
    reach = np.maximum.accumulate(rank * width + hi)
    first = np.flatnonzero(np.concatenate([[True], rank[1:] * width + lo[1:] > reach[:-1]]))
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], name[first], lo[first], reach[last] - rank[last] * width


def _later(least: int, sort_words: int, buckets: int):
    """Spans of all occurrences but the first of each repeat.

    One span for each occurrence is enough: that of the smallest interval in which it isn't first.  Inner
    intervals come before outer ones and leave only their first occurrence to them, so the work grows
    with the suffixes, however many repeats a self-repeating text has.
    """
    build = _array(sort_words)

    def scan(members: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        order, lcp, _, first, docs, start, ends, names = build(members)
        inner = [0] * len(order)  # the longest repeat at each place of the order
        open_: list[list[int]] = []  # for each open stretch of the order: its first place, and the place of its first occurrence
        for length, i, j in intervals(lcp):
            if length < least:
                continue
            lead = []
            at = j
            while at >= i:
                if open_ and open_[-1][0] <= at <= open_[-1][2]:
                    low, who, _ = open_.pop()
                    lead.append(who)
                    at = low - 1
                else:
                    lead.append(at)
                    inner[at] = length
                    at -= 1
            best = min(lead, key=lambda k: (docs[order[k]][0], start[order[k]]))
            for k in lead:
                if k != best:
                    x = order[k]
                    yield docs[x][0], names[x], start[x], start[x] + length
            open_.append([i, best, j])
        for k, x in enumerate(order):
            for d in docs[x][1:]:  # further copies of a text
                n = max(inner[k], ends[x] if first[x] and ends[x] >= least else 0)
                if n:
                    yield d, names[x], start[x], start[x] + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[bytes]] = {}
        for p in core.payloads(batches):
            groups.setdefault(int(np.frombuffer(p, np.int64, 1)[0]), []).append(p)
        packer, held = core.Packer(buckets), []

        def send() -> Iterator[pa.RecordBatch]:
            doc, name, lo, hi = _joined(*np.array(held, dtype=np.int64).T)
            yield from packer.add(doc.view(np.uint64), doc, name, lo.astype(np.uint32), hi.astype(np.uint32))
            held.clear()

        for h in list(groups):
            for row in scan(groups.pop(h)):
                held.append(row)
                if len(held) >= 1 << 18:
                    yield from send()
        if held:
            yield from send()
        yield from packer.flush()

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, name, lo, hi = core.unpack(core.payloads(batches), ["i8", "i8", "u4", "u4"])
    if len(doc):
        doc, name, lo, hi = _joined(doc, name, lo.astype(np.int64), hi.astype(np.int64))
        cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(name) != 0)) + 1).tolist(), len(doc)]
        both = np.stack([lo, hi], axis=1).astype(np.uint32)
        yield pa.record_batch([pa.array(doc[cuts[:-1]]), pa.array(name[cuts[:-1]]), pa.array([both[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["of", "name", "spans"])


def _cut(text_at: int, chars_at: int):
    """Take the spans out of the texts; a text of which nothing stays goes as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *cols, spans = batch.columns
            texts, keep = cols[text_at].to_pylist(), np.ones(batch.num_rows, dtype=bool)
            for i, found in enumerate(spans.to_pylist()):
                if found is None:
                    continue
                w = core.words_of(pa.array([texts[i]], pa.string()), fold=False)
                data, parts, at = texts[i].encode(), [], 0
                for lo, hi in np.frombuffer(found, np.uint32).reshape(-1, 2).tolist():
                    parts.append(data[at : int(w.start[lo])])
                    at = int(w.start[hi]) if hi < len(w.start) else len(data)
                texts[i] = b"".join([*parts, data[at:]]).decode()
                keep[i] = texts[i].strip() != ""
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if chars_at >= 0:
                n = np.asarray([None if t is None else len(t) for t in texts], dtype=object)
                cut = np.asarray([s is not None for s in spans.to_pylist()], dtype=bool)
                old = cols[chars_at].to_pylist()
                cols[chars_at] = pa.array([x if c else y for x, y, c in zip(n, old, cut)], cols[chars_at].type)
            yield pa.record_batch(cols, names=batch.schema.names[:-1]).filter(pa.array(keep))

    return run


def without_repeats(docs: DataFrame, *, least: int = LEAST) -> DataFrame:
    """``docs`` with every repeat of ``least`` words or more left only where it is first (by doc_id and place).

    All columns stay; ``n_chars``, where there is one, follows the text.  A text of which nothing is left
    goes.  Each text of a doc_id is cut by itself, and rows without a doc_id come last; rows of one doc_id
    (or of none) and one text are alike.  Null texts stay.
    """
    p = core.parts(docs)
    last = f"coalesce(CAST({{}} AS BIGINT), {(1 << 63) - 1})"
    ids = core.pick(docs, "doc_id", "text").selectExpr(f"{last.format('doc_id')} AS doc_id", "text")
    later = core.spread(core.spread(_suffixes(ids, least), p).mapInArrow(core.lean(_later(least, SORT_WORDS, p)), core.PACKED), p)
    spans = later.mapInArrow(core.lean(_spans), "of bigint, name bigint, spans binary")
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    same = (F.expr(last.format(f"c{doc_at}")) == F.col("of")) & (F.xxhash64(f"c{text_at}") == F.col("name"))
    joined = docs.toDF(*names).join(spans, same, "left").drop("of", "name")
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return joined.mapInArrow(core.lean(_cut(text_at, chars_at)), fields).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_repeats(core.table(spark, sf_dir, "documents"))
