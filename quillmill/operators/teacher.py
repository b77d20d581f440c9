"""Compression by a language model behind an injectable client, and the corpus that it makes.

A client is anything with ``complete(prompt) -> str`` that can be pickled.  Rows go through it in the workers; a call
that fails is tried again with growing pauses and then counts as a failure, never as the end of the job.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..shipping import ship
from . import align

PROMPTS = {
    "baseline": "Shorten the text below by leaving out words that carry little meaning. Keep the order of the words that stay, add none, change none.",
    "negation": (
        "Shorten the text below by leaving out words that carry little meaning. Keep the order of the words that stay, add none, change none. "
        "Every word that denies something (not, no, never, without, n't) must stay with the word that it denies, and every number must stay as it is."
    ),
}


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass
class Usage:
    calls: int = 0
    failures: int = 0
    words_in: int = 0
    words_out: int = 0

    def add(self, prompt: str, answer: str | None) -> None:
        self.calls += 1
        self.failures += answer is None
        self.words_in += len(prompt.split())
        self.words_out += len((answer or "").split())


@dataclass
class StubClient:
    """Offline: the first ``words`` words of what follows the last blank line of the prompt."""

    words: int = 4

    def complete(self, prompt: str) -> str:
        return " ".join(prompt.rsplit("\n\n", 1)[-1].split()[: self.words])


@dataclass
class Retrying:
    """A client whose failed calls are tried again after ``pause``, twice that, and so on."""

    client: Client
    tries: int = 3
    pause: float = 1.0
    usage: Usage = field(default_factory=Usage)

    def complete(self, prompt: str) -> str | None:
        for k in range(self.tries):
            try:
                answer = self.client.complete(prompt)
            except Exception:  # whatever the client raises, the row is what fails
                if k + 1 < self.tries:
                    time.sleep(self.pause * 2**k)
                continue
            self.usage.add(prompt, answer)
            return answer
        self.usage.add(prompt, None)
        return None


def prompt_of(text: str, kind: str = "negation", rules: str = "") -> str:
    if kind not in PROMPTS:
        raise ValueError(f"no prompt {kind!r}; there are: {', '.join(PROMPTS)}")
    return f"{PROMPTS[kind]}{' ' + rules if rules else ''}\n\n{text}"


def compress_with_teacher(
    docs: DataFrame, client: Client, *, text: str = "text", key: str = "doc_id", kind: str = "negation", rules: str = "", tries: int = 3, pause: float = 1.0,
) -> DataFrame:
    """(key, original, output): null where the text is null or blank, or the client failed."""
    prompt_of("", kind)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Retrying(client, tries, pause)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [align.strip_envelope(mine.complete(prompt_of(t, kind, rules))) if t and t.strip() else None for t in texts]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.string())], names=[key, "original", "output"])

    kind_of_key = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind_of_key}, original string, output string")


def generate_corpus(docs: DataFrame, client: Client, path: str, *, key: str = "doc_id", **options) -> dict:
    """Append pairs and labels of the documents that ``path`` doesn't have yet; gives counts of this run.

    What is there already is left out by an anti-join on the key, so a run that broke off goes on where it was.
    ``pileups`` counts outputs with a run of negations longer than the original's by the alarm's length or more.
    """
    spark = docs.sparkSession
    todo = docs
    try:
        todo = docs.join(spark.read.parquet(f"{path}/pairs").select(key).distinct(), key, "left_anti")
    except Exception as why:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(why):
            raise
    # Written once: the client must not be asked again for the labels and counts.
    made = storage.kept(compress_with_teacher(todo, client, key=key, **options), "teacher")
    good = made.where("length(output) > 0")
    labels = storage.kept(align.annotate(good, "original", "output", key=key), "labels")
    labels.write.mode("append").parquet(f"{path}/labels")
    good.write.mode("append").parquet(f"{path}/pairs")
    counts = made.agg(F.count("*").alias("asked"), F.count(F.when(F.length("output") > 0, 1)).alias("written")).first()
    alarms = labels.where(F.col("pileup") >= align.PILEUP_ALARM).count()
    return {"asked": counts.asked, "written": counts.written, "failed": counts.asked - counts.written, "pileups": alarms}
