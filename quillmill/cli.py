"""Command line: compress, verify, backends, train, benchmark.  Exit codes: 0 fine, 1 error, 2 warnings."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from .functions import lexicon
from .operators import align, blocks, chunking, report, verify as V
from .plans import api, registry


def _rate(text: str) -> float:
    value = float(text)
    if not 0.01 <= value <= 1:
        raise argparse.ArgumentTypeError("rate must lie between 0.01 and 1")
    return value


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillmill").getOrCreate()


def _read(source: str) -> str:
    return sys.stdin.read() if source == "-" else Path(source).read_text(encoding="utf-8")


def _output(source: str, tag: str) -> Path:
    p = Path(source)
    return p.with_name(f"{p.stem}.{tag}{p.suffix}" if p.suffix else f"{p.name}.{tag}.txt")


def _compress(a: argparse.Namespace) -> int:
    texts, failed = [], False
    for source in a.files:
        try:
            texts.append((source, _read(source)))
        except (OSError, UnicodeDecodeError) as why:
            print(f"{source}: {why}", file=sys.stderr)
            failed = True
    if a.output and len(a.files) > 1:
        raise ValueError("--output goes with one file")
    code = [] if a.no_code_skip else [(s, t) for s, t in texts if blocks.looks_like_code(t, None if s == "-" else s)]
    prose = [x for x in texts if x not in code]
    options = {"backend_kwargs": {"language": a.language}} if a.language else {}
    results = api.Compressor(_session(), a.backend, rate=a.rate, verify=not a.no_verify, chunk_tokens=a.chunk_tokens, **options).compress_batch([t for _, t in prose]) if prose else []
    rows = [{"source": s} | r.to_dict() for (s, _), r in zip(prose, results)]
    if a.json:
        print(json.dumps(rows[0] if len(a.files) == 1 and rows else rows, ensure_ascii=False))
    else:
        for s, t in [*code, *((s, r.text) for (s, _), r in zip(prose, results))]:
            t = t if t.endswith("\n") else t + "\n"
            if s == "-" or a.stdout:
                sys.stdout.write(t)
            else:
                (Path(a.output) if a.output else _output(s, a.tag)).write_text(t, encoding="utf-8")
    for (s, _), r in zip(prose, results):
        print(f"{s}: {r.original_tokens} -> {r.compressed_tokens} tokens ({r.ratio:.2f})", *[f"  {w}" for w in r.warnings], sep="\n", file=sys.stderr)
    return 1 if failed else 2 if any(r.warnings for r in results) else 0


def _verify(a: argparse.Namespace) -> int:
    found = V.verify(_read(a.original), _read(a.compressed), language=a.language)
    print(json.dumps({"warnings": found, "clean": not found}, ensure_ascii=False) if a.json else "\n".join(found) or "no warnings")
    return 2 if found else 0


def _backends(a: argparse.Namespace) -> int:
    for b in [registry.backend_info()] if a.json else registry.backend_info():
        print(json.dumps(b) if a.json else f"{b['name']}: {b['description']}")
    return 0


def _prepare(a: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    rows = _session().read.parquet(a.pairs).withColumn("doc_id", F.monotonically_increasing_id())
    pairs = align.pairs_of(rows).withColumn("doc_id", F.xxhash64("doc_id", "n"))
    kept = align.filter_examples(align.annotate(pairs))
    print(json.dumps(align.write_shards(align.split_shards(kept, val_fraction=a.val_fraction, seed=a.seed), a.out)))
    return 0


def _plain(rows: list) -> list[dict]:
    return [r if isinstance(r, dict) else r.asDict(recursive=True) for r in rows]


def _generate(a: argparse.Namespace) -> int:
    """Offline only: the stub client stands in for a language model; others are given to ``generate_corpus`` in Python."""
    from .operators import teacher

    docs = _session().read.parquet(a.docs).select(a.key, "text")
    print(json.dumps(teacher.generate_corpus(docs, teacher.StubClient(a.words), a.out, key=a.key, kind=a.prompt)))
    return 0


def _distill(a: argparse.Namespace) -> int:
    """Scores of teachers: rows (model, doc_id, original, output)."""
    print(json.dumps(_plain(align.score_teachers(_session().read.parquet(a.samples)).collect())))
    return 0


def _run(a: argparse.Namespace) -> int:
    from .operators import training

    shards = align.read_shards(_session(), a.shards)
    model = training.train(shards.where("shard = 'train'"), training.TrainConfig(bits=a.bits, iterations=a.iterations))
    model.write().overwrite().save(f"{a.out}/model")
    found = training.evaluate_tokens(model, shards.where("shard = 'val'"))
    print(training.write_metrics(a.out, **found).read_text(encoding="utf-8"), end="")
    return 0


def _watch(a: argparse.Namespace) -> int:
    """Prints metrics.json whenever it changes, until ``--times`` changes were seen or ``--wait`` seconds brought none."""
    path, last, seen, idle = Path(a.out) / "metrics.json", None, 0, 0.0
    while seen < a.times and idle <= a.wait:
        now = path.read_text(encoding="utf-8") if path.exists() else None
        if now is not None and now != last:
            print(now, end="")
            last, idle, seen = now, 0.0, seen + 1
        else:
            time.sleep(min(0.2, a.wait) or 0.01)
            idle += 0.2
    return 0 if seen else 1


def _evaluate(a: argparse.Namespace) -> int:
    docs = _session().read.parquet(a.docs).select(a.key, "text")
    run = lambda d, rate: api.compress_documents(d, rate, a.backend, key=a.key)
    rows = report.evaluate_backend(docs, run, tuple(a.rates), name=a.backend)
    print(json.dumps(rows) if a.json else report.format_table(rows))
    return 0


def _benchmark(a: argparse.Namespace) -> int:
    """Question answering over compressed contexts; the answers are the offline client's."""
    from pyspark.sql import functions as F

    rows = _session().read.json(a.questions)
    if "idx" not in rows.columns:
        rows = rows.withColumn("idx", F.xxhash64("prompt"))
    made = {b: (lambda d, rate, b=b: api.compress_documents(d, rate, b)) for b in a.backends}
    done = sorted(_plain(report.run_benchmark(report.load_qa(rows, limit=a.limit), made, tuple(a.rates)).collect()), key=lambda r: (r["backend"] != "original", r["backend"], -r["rate"]))
    if a.out:
        report.render_charts(done, a.out)
        (Path(a.out) / "results.json").write_text(json.dumps(done, indent=2), encoding="utf-8")
    print(json.dumps(done))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("quillmill", description=__doc__)
    sub = parser.add_subparsers(required=True)
    p = sub.add_parser("compress")
    p.add_argument("files", nargs="+")
    p.add_argument("--rate", type=_rate, default=0.5)
    p.add_argument("--backend")
    p.add_argument("--tag", default="short")
    p.add_argument("--language", choices=lexicon.available_languages())
    p.add_argument("--output")
    p.add_argument("--chunk-tokens", type=int, default=chunking.MAX_TOKENS)
    for flag in ("--json", "--stdout", "--no-verify", "--no-code-skip"):
        p.add_argument(flag, action="store_true")
    p.set_defaults(run=_compress)
    p = sub.add_parser("verify")
    p.add_argument("original")
    p.add_argument("compressed")
    p.add_argument("--language", default="en")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=_verify)
    p = sub.add_parser("backends")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=_backends)
    train = sub.add_parser("train").add_subparsers(required=True)
    p = train.add_parser("generate")
    p.add_argument("docs")
    p.add_argument("out")
    p.add_argument("--key", default="doc_id")
    p.add_argument("--prompt", default="negation")
    p.add_argument("--words", type=int, default=4)
    p.set_defaults(run=_generate)
    p = train.add_parser("distill")
    p.add_argument("samples")
    p.set_defaults(run=_distill)
    p = train.add_parser("run")
    p.add_argument("shards")
    p.add_argument("out")
    p.add_argument("--bits", type=int, default=16)
    p.add_argument("--iterations", type=int, default=50)
    p.set_defaults(run=_run)
    p = train.add_parser("watch")
    p.add_argument("out")
    p.add_argument("--times", type=int, default=1)
    p.add_argument("--wait", type=float, default=0.0)
    p.set_defaults(run=_watch)
    p = train.add_parser("evaluate")
    p.add_argument("docs")
    p.add_argument("--backend", default="rules")
    p.add_argument("--rates", type=_rate, nargs="+", default=list(report.RATES))
    p.add_argument("--key", default="doc_id")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=_evaluate)
    bench = sub.add_parser("benchmark").add_subparsers(required=True)
    p = bench.add_parser("qa")
    p.add_argument("questions")
    p.add_argument("--backends", nargs="+", default=["rules"])
    p.add_argument("--rates", type=_rate, nargs="+", default=[0.5])
    p.add_argument("--limit", type=int)
    p.add_argument("--out")
    p.set_defaults(run=_benchmark)
    p = train.add_parser("prepare")
    p.add_argument("pairs")
    p.add_argument("out")
    p.add_argument("--val-fraction", type=float, default=0.05)
    p.add_argument("--seed", type=int, default=0)
    p.set_defaults(run=_prepare)
    a = parser.parse_args(argv)
    try:
        return a.run(a)
    except (OSError, ValueError, KeyError, ImportError) as why:
        print(f"error: {why}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
