"""Public surface: compress a table or one text, verify pairs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, rules, verify as V
from . import registry

PRESERVE = ("preserve_code", "preserve_inline_code", "preserve_markdown", "preserve_numbers", "preserve_identifiers")


def _backend(backend, backend_kwargs: dict | None, options: dict) -> registry.Backend:
    """Checks everything on the driver, before a job runs."""
    if isinstance(backend, registry.Backend):
        if backend_kwargs:
            raise TypeError("backend_kwargs go with a backend's name, not with an instance")
        made = backend
    else:
        made = registry.create_backend(backend or registry.default_backend_name(), **(backend_kwargs or {}))
    misplaced = sorted(set(options) & set(made.construction_only))
    if misplaced:
        raise TypeError(f"{', '.join(misplaced)}: give these in backend_kwargs")
    if options:
        raise TypeError(f"unexpected arguments: {', '.join(sorted(options))}")
    return made


def compress_documents(
    docs: DataFrame, rate: float = 0.5, backend: str | registry.Backend | None = None, *, text: str = "text", key: str = "doc_id", verify: bool = True,
    chunk_tokens: int = chunking.MAX_TOKENS, backend_kwargs: dict | None = None, **options,
) -> DataFrame:
    """(key, compressed, token counts, ratio, warnings, counts of chunks and dropped words) of each document.

    No shuffle, unless the backend moves rows: chunks are rows between two steps of one stage.  A null text gives nulls.
    """
    rate = rules.check_rate(rate)
    preserve = {k: bool(options.pop(k)) for k in PRESERVE if k in options}
    made = _backend(backend, backend_kwargs, options)
    rows = chunking.chunk_rows(docs, key, text, chunk_tokens, **preserve)
    done = made.compress(rows, rate, "_body", "_out").withColumnRenamed("_out_dropped", "_dropped")
    if not made.keeps_order:
        done = done.repartition("_doc").sortWithinPartitions("_doc", "_n")
    return chunking.rejoin_rows(done, key, made.language, verify).withColumn("backend", F.lit(made.name))


def verify_pairs(pairs: DataFrame, **options) -> DataFrame:
    return V.verify_pairs(pairs, **options)


@dataclass
class CompressionResult:
    text: str
    original_tokens: int
    compressed_tokens: int
    ratio: float
    backend: str
    warnings: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    @property
    def saved_tokens(self) -> int:
        return self.original_tokens - self.compressed_tokens

    def to_dict(self) -> dict:
        return asdict(self) | {"saved_tokens": self.saved_tokens}


class Compressor:
    """One configuration for many texts or tables."""

    def __init__(self, spark: SparkSession, backend: str | registry.Backend | None = None, *, rate: float = 0.5, backend_kwargs: dict | None = None, **options) -> None:
        self.spark, self.rate, self.options = spark, rules.check_rate(rate), options
        self.backend = _backend(backend, backend_kwargs, {k: v for k, v in options.items() if k not in (*PRESERVE, "verify", "chunk_tokens")})

    @property
    def backend_name(self) -> str:
        return self.backend.name

    def documents(self, docs: DataFrame, rate: float | None = None, **options) -> DataFrame:
        return compress_documents(docs, self.rate if rate is None else rate, self.backend, **(self.options | options))

    def compress_batch(self, texts: list[str], rate: float | None = None, **options) -> list[CompressionResult]:
        docs = self.spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        out = []
        for r in self.documents(docs, rate, **options).orderBy("doc_id").collect():
            meta = {k: r[k] for k in ("chunks", "compressed_chunks", "code_blocks_preserved", "dropped_words")}
            out.append(CompressionResult(r.compressed, r.original_tokens, r.compressed_tokens, r.ratio, r.backend, list(r.warnings), meta))
        return out

    def compress(self, text: str, rate: float | None = None, **options) -> CompressionResult:
        return self.compress_batch([text], rate, **options)[0]


def compress(spark: SparkSession, text: str, rate: float = 0.5, backend: str | registry.Backend | None = None, *, backend_kwargs: dict | None = None, **options) -> CompressionResult:
    return Compressor(spark, backend, rate=rate, backend_kwargs=backend_kwargs, **options).compress(text)
