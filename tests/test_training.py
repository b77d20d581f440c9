"""Training, teachers, comparisons and the command line around them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmill import cli
from quillmill.functions import lexicon, text as T
from quillmill.operators import align, chunking, ranker, report, rules, teacher, training
from quillmill.plans import api, registry


def pairs(spark, n=60):
    rnd = random.Random(1)
    words = ["the", "of", "a", "cat", "house", "river", "stone", "garden"]
    rows = []
    for i in range(n):
        t = [rnd.choice(words) for _ in range(20)]
        rows.append((i, " ".join(t), " ".join(w for w in t if w not in ("the", "of", "a"))))
    return spark.createDataFrame(rows, "doc_id long, original string, compressed string")


def test_a_model_learns_which_words_stay(spark):
    examples = align.annotate(pairs(spark))
    model = training.train(examples, training.TrainConfig(bits=12))
    found = training.evaluate_tokens(model, examples)
    assert found["f1"] > 0.99 and found["tokens"] == 1200 and found["perplexity"] < 1.5
    docs = spark.createDataFrame([(1, "the garden of a stone"), (2, "the garden of a stone"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.compressed for r in ranker.select(docs, 0.4, scorer=training.model_scorer(model)).collect()}
    assert got == {1: "garden stone", 2: "garden stone", 3: None, 4: ""}
    with pytest.raises(ValueError):
        training.TrainConfig(bits=99)


def test_scorers_that_move_rows_in_whole_documents(spark):
    """Chunks of many documents come together again, and a backend that hides its exchange is refused."""
    docs = spark.createDataFrame([(i, "\n\n".join(f"part {k} of the document {i} with the word w{i}" for k in range(5))) for i in range(40)], "doc_id long, text string").repartition(4)
    scorer = ranker.idf_scorer(docs)
    got = {r.doc_id: r.compressed for r in api.compress_documents(docs, 0.6, "ranker", chunk_tokens=12, backend_kwargs={"scorer": scorer}).collect()}
    assert len(got) == 40 and all(f"w{i}" in t and t.count("\n\n") == 4 for i, t in got.items())

    class Hidden(registry.Backend):
        name = "hidden"

        def compress(self, rows, rate, text, out):
            return rows.orderBy(F.desc("_n")).withColumns({out: F.col(text), f"{out}_dropped": F.lit(0)})

    with pytest.raises(Exception, match="not together"):
        api.compress_documents(docs, 0.6, Hidden(), chunk_tokens=12).collect()


def test_small_parts():
    assert training.windows([3, 3, 9, 1], 6) == [(0, 2), (2, 3), (3, 4)] and training.windows([], 5) == []
    assert training.subword_counts(["a", ""], list) == [1, 1]
    assert training.preserve_label_id({0: "drop", 1: "KEEP"}) == 1 and training.preserve_label_id({0: "x"}) == 0
    assert chunking.merge_metadata([{"n": 1, "w": ["a"], "b": True, "r": 0.5}, {"n": 2, "w": ["b"], "b": False, "r": 0.7, "z": "late"}]) == {"n": 3, "w": ["a", "b"], "b": True, "r": 0.5, "z": "late"}
    assert T.tokenizer_name() == "whitespace" and T.tokenizer_name("/x/bpe.json") == "bpe.json"
    with pytest.raises(ValueError):
        lexicon.RuleSet(lexicon.WordClassRule(" "))
    rs = lexicon.ENGLISH.rules.replace(lexicon.WordClassRule("articles", {"x"}), lexicon.WordClassRule("fillers", {"y"}))
    assert rs["articles"].words == {"x"} and rs.names == lexicon.ENGLISH.rules.names
    with pytest.raises(KeyError):
        rs.replace(lexicon.WordClassRule("no such rule"))


def test_rules_may_nominate_by_place(spark):
    class Last(lexicon.Rule):
        def nominate(self, cores):
            return F.transform(cores, lambda c, i: F.when(i == F.size(cores) - 1, F.lit(1.0)))

    docs = spark.createDataFrame([(1, "one two three"), (2, "one not")], "doc_id long, text string")
    got = {r.doc_id: r.compressed for r in rules.compress(docs, 0.2, rules=lexicon.RuleSet(Last("last"))).collect()}
    assert got == {1: "one two", 2: "one not"}


def flaky():
    class Flaky:
        """Fails on one text and stammers negations on another."""

        def complete(self, prompt):
            text = prompt.rsplit("\n\n", 1)[-1]
            if "fail" in text:
                raise OSError("no")
            return "Here is the text:\n\nnot not not not not not" if "stammer" in text else " ".join(text.split()[:3])

    return Flaky()


def test_corpus_of_a_teacher_goes_on_where_it_was(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "please fail"), (3, "stammer not"), (4, " "), (5, None)], "doc_id long, text string")
    first = teacher.generate_corpus(docs.where("doc_id < 3"), flaky(), str(tmp_path / "c"), pause=0)
    assert first == {"asked": 2, "written": 1, "failed": 1, "pileups": 0}
    second = teacher.generate_corpus(docs, flaky(), str(tmp_path / "c"), pause=0)
    assert second == {"asked": 4, "written": 1, "failed": 3, "pileups": 1}
    assert sorted((r.doc_id, r.output) for r in spark.read.parquet(str(tmp_path / "c/pairs")).collect()) == [(1, "a b c"), (3, "not not not not not not")]
    assert spark.read.parquet(str(tmp_path / "c/labels")).where("doc_id = 1").first().labels == [True, True, True, False, False]
    with pytest.raises(ValueError):
        teacher.compress_with_teacher(docs, flaky(), kind="no such prompt")


def test_compare_and_charts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat is not on the mat"), (2, "it is a house of 5 cats")], "doc_id long, text string")
    run = lambda d, rate: api.compress_documents(d, rate, "rules")
    rows = report.evaluate_backend(docs, run, (1.0, 0.5), name="rules")
    assert [r["rate"] for r in rows] == [1.0, 0.5] and rows[0]["ratio"] == 1 > rows[1]["ratio"] and all(r["seconds_per_document"] > 0 for r in rows)
    paths = report.render_charts([{"backend": "rules", "rate": 0.5, "ratio": 0.6, "f1": 0.7}], str(tmp_path / "charts"))
    assert len(paths) == 1 and "<svg" in open(paths[0]).read()


def test_vocabulary_tokens(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    docs = spark.createDataFrame([("hello hello",), (None,), ("",)], "text string")
    assert [r[0] for r in docs.select(T.encoded_counts(F.col("text"), str(path))).collect()][1:] == [None, 0]


def test_train_and_benchmark_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    pairs(spark, 30).select("doc_id", F.col("original").alias("text")).write.parquet(docs)
    said = lambda: capsys.readouterr().out
    assert cli.main(["train", "generate", docs, out]) == 0 and json.loads(said())["written"] == 30
    examples = align.split_shards(align.annotate(pairs(spark)), val_fraction=0.2)
    align.write_shards(examples, str(tmp_path / "shards"))
    assert cli.main(["train", "run", str(tmp_path / "shards"), out, "--bits", "10", "--iterations", "5"]) == 0 and json.loads(said())["f1"] > 0.9
    assert cli.main(["train", "watch", out]) == 0 and "perplexity" in said()
    assert cli.main(["train", "evaluate", docs, "--rates", "0.5", "--json"]) == 0 and json.loads(said())[0]["documents"] == 30
    qa = tmp_path / "qa.json"
    qa.write_text(json.dumps({"prompt": "the cat is on the mat", "QA_pairs": [{"question": "where?", "answer": "cat is on"}]}) + "\n")
    assert cli.main(["benchmark", "qa", str(qa), "--out", str(tmp_path / "bench")]) == 0
    assert [r["backend"] for r in json.loads(said())] == ["original", "rules"] and (tmp_path / "bench/f1.svg").exists()
    bad, good = tmp_path / "bad.txt", tmp_path / "good.txt"
    bad.write_bytes(b"\xff\xfe\xff")
    good.write_text("it is the cat of the house")
    assert cli.main(["compress", str(bad), str(good), "--stdout"]) == 1 and "cat" in said()
    assert cli.main(["compress", str(good), "--output", str(tmp_path / "small.txt"), "--language", "en", "--no-code-skip"]) == 0 and "cat" in (tmp_path / "small.txt").read_text()
