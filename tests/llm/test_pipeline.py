"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from quillmill.llm import suffix_repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(rnd):
    text = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.randint(0, 4000)}" for _ in range(n))
    clean = [text(120) for _ in range(30)]
    passage, item = text(60), text(40)
    toxic = [f"{text(10)} idiot {text(10)} moron" for _ in range(12)]
    docs = dict(enumerate(clean))
    docs |= {100 + i: t for i, t in enumerate(toxic)}
    near = clean[3].split()
    near[60] = "changed"
    docs |= {200: " ".join(near), 201: clean[3], 210: f"{text(80)} {passage} {text(80)}", 211: f"{text(80)} {passage} {text(80)}", 220: f"{text(50)} {item} {text(50)}", 230: None, 231: ""}
    return docs, passage, item


def test_stages(spark, tmp_path):
    docs, passage, item = corpus(random.Random(1))
    rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in docs.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(100 <= d < 106)) for d in [*range(20), *range(100, 106)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = set(docs)
    gone = [set(range(100, 112)), {200, 201}, set(), {220}]
    for (name, stage), drop in zip(corpus_pipeline.STAGES[:-1], gone):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left -= drop
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r.doc_id for r in now.select("doc_id").collect()} == left, name
    text = {r.doc_id: r for r in now.collect()}
    assert passage in text[210].text and passage not in text[211].text and len(text[211].text) == text[211].n_chars
    assert all(text[d].text == docs[d] for d in left - {211})
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").sum("n_words").collect()
    assert {r[0]: r[1] for r in packed} == {d: len(r.text.split()) for d, r in text.items() if r.text}


def test_cut_edges(spark):
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one, None), (2, one, None), (3, "x " + one + "\nÄ y", 9), (None, one, 1), (5, None, None), (6, one, 0), (6, "other", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {(r.doc_id, r.text, r.n_chars) for r in suffix_repeats.without_repeats(docs, least=20).collect()}
    assert got == {(1, one, None), (3, "x Ä y", 5), (5, None, None), (6, "other", 0)}
    # Rows without a doc_id come last; a doc_id's texts are cut each, also against each other.
    rows = [(None, one + " a", None), (None, "b " + one, None), (7, one, None), (7, "c " + one, None), (7, "c " + one, None)]
    got = sorted((r.doc_id or 0, r.text) for r in suffix_repeats.without_repeats(spark.createDataFrame(rows, docs.schema), least=20).collect())
    assert [(d, len(t.split())) for d, t in got] == [(0, 1), (0, 1), (7, 1), (7, 1), (7, 60)] or [(d, len(t.split())) for d, t in got] == [(0, 1), (0, 1), (7, 61), (7, 61)]
    assert suffix_repeats.without_repeats(docs.limit(0)).count() == 0


def test_cut_against_brute_force(spark):
    from test_repeats import corpus as repeated

    for seed, least in ((1, 5), (2, 20), (5, 12)):
        rows = {d: t for d, t, *_ in repeated(seed) if d is not None and d != 3 and t}
        docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
        seen, want = set(), {}
        for d in sorted(rows):
            w = rows[d].split()
            gone = set()
            for i in range(len(w) - least + 1):
                if tuple(w[i : i + least]) in seen:
                    gone |= set(range(i, i + least))
                seen.add(tuple(w[i : i + least]))
            want[d] = [x for i, x in enumerate(w) if i not in gone]
        got = {r.doc_id: r.text.split() for r in suffix_repeats.without_repeats(docs, least=least).collect()}
        assert got == {d: w for d, w in want.items() if w}


EDGES = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic string, item_id string"


def run_on(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, EDGES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert run_on(spark, tmp_path, [], [], []) == []


def test_pipeline_edges(spark, tmp_path):
    """Null and repeated rows, shared and missing doc_ids, ties, a long text, columns with clashing names."""
    rnd = random.Random(3)
    text = lambda n: " ".join(f"{rnd.choice('bcdfg')}{rnd.randint(0, 9000)}" for _ in range(n))
    a, b, c, long, item = text(80), text(80), text(80), text(30_000), text(40)
    docs = [(1, a), (1, a), (2, a), (3, b), (3, c), (4, None), (5, ""), (6, long), (None, b), (None, text(20)), (None, None), (7, f"{text(9)} {item}"), (8, f"{text(9)} {item}"), (8, text(90))]
    rows = [(d, t, "en", "s", None, "x", "y") for d, t in docs]
    packed = run_on(spark, tmp_path, rows, [(1, None, None), (None, 1, 1), (2, 0, 0)], [(1, item), (2, None), (3, "")])
    words: dict = {}
    for r in packed:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    # 2 is a copy of 1; b in a row without a doc_id comes after 3 and is cut; 7 and 8 hold the benchmark.
    assert words == {1: 160, 3: 160, 6: 30_000, None: 20}
