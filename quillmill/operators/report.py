"""Reports: ratio and faithfulness by backend and rate, question answering, and their sinks."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as T

CHECKS = ("negation lost", "negation kept", "numbers missing", "entities missing")
RATES = (0.7, 0.5, 0.33, 0.2)


def faithfulness(results: DataFrame, *by: str) -> DataFrame:
    """Mean ratio, share of clean documents and of documents with each warning, of ``compress_documents`` rows."""
    has = lambda c: F.avg(F.exists("warnings", lambda w: w.startswith(c)).cast("double"))
    return results.where("warnings IS NOT NULL").groupBy(*by).agg(
        F.count("*").alias("documents"), F.avg("ratio").alias("ratio"), F.avg((F.size("warnings") == 0).cast("double")).alias("clean_fraction"),
        *[has(c).alias(c.replace(" ", "_")) for c in CHECKS],
    )


def totals(results: DataFrame, *by: str) -> DataFrame:
    """Tokens in and out, warnings a document, and ``doc_negation_loss_rate``."""
    return results.where("warnings IS NOT NULL").groupBy(*by).agg(
        F.sum("original_tokens").alias("tokens_in"), F.sum("compressed_tokens").alias("tokens_out"), F.avg(F.size("warnings")).alias("warnings_per_doc"),
        F.avg(F.exists("warnings", lambda w: w.startswith(CHECKS[0])).cast("double")).alias("doc_negation_loss_rate"),
    )


def compare(docs: DataFrame, backends: dict, rates: tuple[float, ...] = RATES) -> DataFrame:
    """Faithfulness of each backend at each rate, with the seconds that a document took.

    ``backends``: name -> function (docs, rate) -> compress_documents rows.  Each run is written once and timed.
    """
    rows = None
    for name, run in backends.items():
        for rate in rates:
            began = time.monotonic()
            done = storage.kept(run(docs, rate).select("original_tokens", "compressed_tokens", "ratio", "warnings"), "run")
            took = time.monotonic() - began
            one = faithfulness(done.withColumns({"backend": F.lit(name), "rate": F.lit(float(rate))}), "backend", "rate")
            one = one.withColumn("seconds_per_document", F.lit(took) / F.greatest(F.lit(1), F.col("documents")))
            rows = one if rows is None else rows.unionByName(one)
    return rows


def evaluate_backend(docs: DataFrame, run, rates: tuple[float, ...] = RATES, *, name: str = "backend") -> list[dict]:
    """``compare`` of one backend, by falling rate."""
    return [r.asDict() for r in compare(docs, {name: run}, rates).orderBy(F.desc("rate")).collect()]


def load_qa(rows: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(idx, context, n, question, answer) of rows with prompt and QA_pairs (array of structs or JSON)."""
    pairs = F.from_json("QA_pairs", "array<struct<question: string, answer: string>>") if dict(rows.dtypes)["QA_pairs"] == "string" else F.col("QA_pairs")
    some = rows.where("length(prompt) > 0").withColumn("_p", F.filter(pairs, lambda p: F.length(p.question) > 0)).where("size(_p) > 0")
    some = some if limit is None else some.orderBy("idx").limit(limit)
    return some.select("idx", F.col("prompt").alias("context"), F.posexplode("_p").alias("n", "p")).select("idx", "context", "n", "p.question", F.coalesce("p.answer", F.lit("")).alias("answer"))


def stub_answer(context: Column) -> Column:
    """The offline client: the context's first four words."""
    return F.array_join(F.slice(T.words(context), 1, 4), " ")


def qa_scores(answers: DataFrame, *by: str, prediction: str = "prediction", gold: str = "answer") -> DataFrame:
    """Mean exact match and F1 of (prediction, answer) rows."""
    em, f1 = T.exact_match(F.col(prediction), F.col(gold)), T.token_f1(F.col(prediction), F.col(gold))
    return answers.groupBy(*by).agg(F.avg(em).alias("exact_match"), F.avg(f1).alias("f1"), F.count("*").alias("n"))


def run_benchmark(qa: DataFrame, backends: dict, rates: tuple[float, ...], *, answer=stub_answer) -> DataFrame:
    """One row for the original and each backend and rate: tokens, ratio, warnings, EM and F1.

    ``backends``: name -> function (docs, rate) -> compress_documents rows.
    """
    contexts = qa.select("idx", "context").dropDuplicates(["idx"]).select(F.col("idx").alias("doc_id"), F.col("context").alias("text"))
    plans = [("original", 1.0, contexts.select("doc_id", F.col("text").alias("compressed"), T.count_tokens(F.col("text")).alias("original_tokens"), T.count_tokens(F.col("text")).alias("compressed_tokens"), F.lit(1.0).alias("ratio"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("warnings")))]
    plans += [(name, rate, f(contexts, rate).select("doc_id", "compressed", "original_tokens", "compressed_tokens", "ratio", "warnings")) for name, f in backends.items() for rate in rates]
    rows = None
    for name, rate, done in plans:
        one = done.withColumns({"backend": F.lit(name), "rate": F.lit(rate)})
        rows = one if rows is None else rows.unionByName(one)
    answered = qa.join(rows, qa.idx == rows.doc_id).withColumn("prediction", answer(F.col("compressed")))
    out = totals(rows, "backend", "rate").withColumn("ratio", F.col("tokens_out") / F.greatest(F.lit(1), F.col("tokens_in")))
    return out.join(qa_scores(answered, "backend", "rate"), ["backend", "rate"])


def format_table(rows: list[dict]) -> str:
    if not rows:
        return "(no rows)"
    lines = ["backend".ljust(14) + "rate".rjust(6) + "ratio".rjust(8) + "clean".rjust(8)]
    lines.append("-" * len(lines[0]))
    return "\n".join([*lines, *[f"{r.get('backend', '-'):<14}{r['rate']:>6.2f}{r['ratio']:>8.2f}{r['clean_fraction']:>8.2f}" for r in rows]])


def to_svg(rows: list[dict], metric: str = "f1", width: int = 640, height: int = 400) -> str:
    """Scatter of a metric against the ratio; the original's value is a dashed line."""
    pad = 50
    x = lambda v: pad + v * (width - 2 * pad)
    y = lambda v: height - pad - v * (height - 2 * pad)
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">']
    parts.append(f'<path d="M{pad} {pad}V{height - pad}H{width - pad}" fill="none" stroke="#444"/><text x="{width / 2:.0f}" y="{height - 12}">ratio kept</text><text x="8" y="{pad - 12}">{metric}</text>')
    for r in rows:
        if r["backend"] == "original":
            parts.append(f'<path d="M{pad} {y(r[metric]):.1f}H{width - pad}" stroke="#888" stroke-dasharray="4 4"/>')
        else:
            parts.append(f'<circle cx="{x(r["ratio"]):.1f}" cy="{y(r[metric]):.1f}" r="4"/><text x="{x(r["ratio"]) + 6:.1f}" y="{y(r[metric]) - 6:.1f}">{r["backend"]} {r["rate"]:g}</text>')
    return "".join([*parts, "</svg>"])


def render_charts(rows: list[dict], folder: str, metrics: tuple[str, ...] = ("f1", "exact_match", "warnings_per_doc", "doc_negation_loss_rate")) -> list[str]:
    """One SVG for each metric that the rows have; gives the paths."""
    from pathlib import Path

    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    paths = []
    for m in metrics:
        some = [r for r in rows if r.get(m) is not None]
        if some:
            top = max(1.0, max(float(r[m]) for r in some))  # counts are drawn as shares of the largest
            (out / f"{m}.svg").write_text(to_svg([{**r, m: float(r[m]) / top} for r in some], m), encoding="utf-8")
            paths.append(str(out / f"{m}.svg"))
    return paths
