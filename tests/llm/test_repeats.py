"""Substring dedup by recompression, and maximal repeats, against brute force."""

import random
from collections import defaultdict

import pytest

from quillmill.llm import core, recompression, suffix_repeats

SCHEMA = "doc_id bigint, text string, tokens int, name string"


def corpus(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(rnd.choice([2, 3, 40, 400]))]
    pool = [[rnd.choice(words) for _ in range(rnd.randint(5, 90))] for _ in range(3)]
    docs = []
    for d in range(14):
        t: list[str] = []
        for _ in range(rnd.randint(0, 3)):
            pick = rnd.random()
            t += rnd.choice(pool)[rnd.randint(0, 20) :] if pick < 0.5 else [rnd.choice(words)] * rnd.randint(1, 70) if pick < 0.6 else [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        docs.append((d, " ".join(t), 1, "x"))
    return docs + [(3, docs[5][1], 2, "y"), docs[4], docs[4], (None, docs[1][1], 0, None), (77, None, None, None), (78, "", 1, ""), (79, docs[6][1], 1, "copy")]


def windows(docs: list[tuple], least: int) -> set[tuple]:
    seen, hit, out = defaultdict(list), defaultdict(set), set()
    for k, (d, t) in enumerate(sorted({(r[0], r[1]) for r in docs if r[0] is not None and r[1]})):
        w = t.split()
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].append((d, k, i))
    for places in seen.values():
        if len(places) > 1:
            for d, k, i in places:
                hit[d, k].add(i)
    for (d, _), at in hit.items():
        for i in sorted(at):
            if i - 1 not in at:
                j = i
                while j + 1 in at:
                    j += 1
                out.add((d, i, j - i + least))
    return out


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 20), (3, 8), (4, 2), (5, 12), (6, 30)])
def test_recompression_spans(spark, seed, least):
    docs = corpus(seed)
    got = {tuple(r) for r in recompression.repeated_spans(spark.createDataFrame(docs, SCHEMA), least=least).collect()}
    assert got == windows(docs, least)


def maximal(docs: list[tuple], least: int) -> set[tuple]:
    texts = {(d, i): t.split() for i, (d, t) in enumerate(sorted({(r[0], r[1]) for r in docs if r[0] is not None and r[1]}))}
    places = defaultdict(list)
    for (d, k), w in texts.items():
        for i in range(len(w)):
            for j in range(i + least, len(w) + 1):
                places[tuple(w[i:j])].append((d, k, i))
    out = set()
    for s, at in places.items():
        if len(at) < 2:
            continue
        left = {texts[d, k][i - 1] if i else (d, k) for d, k, i in at}
        right = {texts[d, k][i + len(s)] if i + len(s) < len(texts[d, k]) else (d, k) for d, k, i in at}
        if len(left) > 1 and len(right) > 1:
            out.add((len(s), len(at), tuple(sorted((d, i) for d, _, i in at))))
    return out


def groups(tree) -> list[tuple]:
    """(words, occurrences, places) of each repeat, from the tree's rows."""
    n = {r.repeat_id: r.n_occurrences for r in tree.collect()}
    at = defaultdict(list)
    for r in suffix_repeats.occurrences(tree).collect():
        at[r.repeat_id, r.n_words].append((r.doc_id, r.start))
    return [(words, n[k], tuple(sorted(places))) for (k, words), places in at.items()]


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 20), (3, 8), (5, 12), (6, 30)])
def test_maximal_repeats(spark, seed, least):
    docs = corpus(seed)
    tree = suffix_repeats.maximal_repeats(spark.createDataFrame(docs, SCHEMA), least=least).cache()
    rows = tree.collect()
    assert len({(r.repeat_id, r.doc_id, r.start) for r in rows}) == len(rows)
    got = groups(tree)
    assert len(got) == len({r.repeat_id for r in rows})
    assert set(got) == maximal(docs, least)


@pytest.mark.parametrize("seed,least", [(1, 5), (5, 12)])
def test_maximal_repeats_by_doubling(spark, seed, least):
    docs = corpus(seed)
    tree = suffix_repeats.maximal_repeats(spark.createDataFrame(docs, SCHEMA), least=least, sort_words=0)
    assert set(groups(tree)) == maximal(docs, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert recompression.repeated_spans(none).count() == 0
    assert suffix_repeats.maximal_repeats(none).count() == 0


def test_long_text(spark):
    text = " ".join(f"v{i % 997}" for i in range(60_000))
    docs = spark.createDataFrame([(1, text, 0, ""), (2, "x " + text, 0, "")], SCHEMA)
    assert {tuple(r) for r in recompression.repeated_spans(docs).collect()} == {(1, 0, 60_000), (2, 1, 60_000)}


def test_few_windows_are_compared_in_long_repeats(spark, monkeypatch):
    """Segments verify a long passage: its windows are hashed once, for one of its copies, and at its ends."""
    frames = {}
    kept = core.kept
    monkeypatch.setattr(core, "kept", lambda df, name: frames.setdefault(name, kept(df, name)))
    rnd = random.Random(5)
    word = lambda: f"x{rnd.randint(0, 50_000)}"
    passage = [word() for _ in range(4000)]
    docs = [(d, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]), 0, "") for d in range(8)]
    spans = recompression.repeated_spans(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {tuple(r) for r in spans} == {(d, 60, 4000) for d in range(8)}
    compared = sum(len(r.payload) // 21 for r in frames["windows"].where("kind = 0").collect())
    assert 0 < compared < 0.25 * 8 * 4000


@pytest.mark.parametrize("make", ["spans", "repeats"])
def test_hot_passage_and_clashing_columns(spark, make):
    """One passage is in most documents, beside columns named like those used inside."""
    rnd = random.Random(6)
    line = " ".join(f"hot{i}" for i in range(12))
    docs = [(d, f"{' '.join(f'y{rnd.randint(0, 900)}' for _ in range(rnd.randint(0, 9)))} {line}", 1, 2, 3) for d in range(120)] + [(200, None, 0, 0, 0), (201, "", 0, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, name int, bucket int, kind int")
    if make == "spans":
        assert {tuple(r) for r in recompression.repeated_spans(df, least=8).collect()} == windows([r[:2] for r in docs], 8)
    else:
        assert set(groups(suffix_repeats.maximal_repeats(df, least=8))) == maximal([r[:2] for r in docs], 8)
