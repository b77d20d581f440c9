"""Vectorised tokens, packed exchanges and shared-folder helpers for the corpus operators.

A *word* is a maximal run of bytes that are ASCII letters or digits or belong to a non-ASCII
character, after lower-casing (SQL: ``regexp_extract_all(lower(text), WORD_SQL)``).  Words are
hashed and counted with whole-batch NumPy arithmetic, never one word at a time.

Rows that travel between executors are packed: a map task sorts its records by target partition
and sends one binary payload per target, so the JVM moves a few thousand rows instead of many
millions.  Everything is a deterministic function of the input, so a lost executor only means
that Spark runs the same tasks again.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..storage import input_bytes, kept, spread_over_cores  # noqa: F401

#: The same words for DuckDB (RE2) and Python's ``re``.
WORD_SQL = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"

#: Bytes of text handled at once; a longer single text is still handled whole.
SLICE_BYTES = 1 << 20

PACKED = "bucket int, payload binary"

_U = np.uint64
_WORD = np.zeros(256, dtype=bool)
for _c in range(256):
    _WORD[_c] = _c >= 128 or chr(_c).isalnum()
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_R, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length() if n < 1 << 20 else -(-n >> 20) << 20

            def table(x: int) -> np.ndarray:
                full = np.full(size, x, dtype=np.uint64)
                full[0] = 1
                return np.cumprod(full, dtype=np.uint64)

            self.up, self.down = table(self.base), table(self.inv)
        return self.up[:n], self.down[:n]


_BYTES, _GRAMS = _Powers(_R), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public MurmurHash3 constants)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted: plain np.unique hashes, which is much slower than sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Words:
    """Hashed words of some texts: document ``d`` owns ``hash[off[d]:off[d + 1]]``."""

    __slots__ = ("hash", "off", "start", "end", "base")

    def __init__(self, hash_, off, start, end, base) -> None:
        self.hash, self.off, self.start, self.end, self.base = hash_, off, start, end, base

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    @property
    def room(self) -> np.ndarray:
        """For each word, how many words its document has from it on."""
        return np.repeat(self.off[1:], np.diff(self.off)) - np.arange(len(self.hash))


def words_of(texts: pa.Array, *, fold: bool = True) -> Words:
    """Words of an Arrow string array; null counts as the empty text.

    ``start``/``end`` are byte offsets into the (folded) data and ``base`` the documents' first
    bytes.  Folding never changes which word has which number.
    """
    texts = pc.fill_null(texts, "")
    if fold:
        texts = pc.utf8_lower(texts)
    texts = texts.cast(pa.large_string())
    n = len(texts)
    base = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :]
    lo, hi = int(base[0]), int(base[-1])
    base = base - lo
    size = hi - lo
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=hi)[lo:] if size else np.zeros(0, np.uint8)
    word = _WORD[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[base] = True
    before = np.empty(size, dtype=bool)
    if size:
        before[0] = False
        before[1:] = word[:-1]
    first = word & (~before | edge[:size])
    start = np.flatnonzero(first)
    after = np.empty(size, dtype=bool)
    if size:
        after[-1] = False
        after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _BYTES.get(size + 1)
    total = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(hashed, np.searchsorted(start, base), start, end, base)


def grams(w: Words | np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words; those that leave a document are the caller's to mask."""
    h = w.hash if isinstance(w, Words) else w
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _GRAMS.get(len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(h) - n + 1])


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of text or one row."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = np.cumsum(size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
        if b > a:
            yield batch.slice(a, b - a)


# -- memory ----------------------------------------------------------------------------------


def _trim() -> None:
    """Give freed memory back to the system; Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run):
    """``run`` (a function of batches), with its worker trimmed when a task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return task


# -- packed exchange -------------------------------------------------------------------------


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Target partition of each 64-bit key."""
    return (mix(keys.astype(np.uint64) + _U(0x51ED2701)) % _U(n)).astype(np.int32)


def pack(bucket: np.ndarray, cols: Sequence[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(bucket.astype(np.uint16 if len(bucket) and bucket.max() < 65536 else np.int32), kind="stable")
    b = bucket[order]
    cols = [np.ascontiguousarray(c[order]) for c in cols]
    cuts = np.flatnonzero(np.diff(b)) + 1 if len(b) else np.zeros(0, dtype=np.int64)
    lo, hi = [0, *cuts.tolist()], [*cuts.tolist(), len(b)]
    if not len(b):
        lo = hi = []
    return pa.record_batch(
        [
            pa.array([int(b[i]) for i in lo], pa.int32()),
            pa.array([b"".join(c[i:j].tobytes() for c in cols) for i, j in zip(lo, hi)], pa.binary()),
        ],
        names=["bucket", "payload"],
    )


def unpack(payloads: Iterable[bytes], dtypes: Sequence[str]) -> list[np.ndarray]:
    """The columns of all payloads, one after the other."""
    kinds = [np.dtype(t) for t in dtypes]
    width = sum(k.itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // width, 0
        for k, part in zip(kinds, parts):
            part.append(np.frombuffer(p, dtype=k, count=n, offset=at))
            at += n * k.itemsize
    return [np.concatenate(p) if p else np.zeros(0, dtype=k) for p, k in zip(parts, kinds)]


class Packer:
    """Collects columns and gives a packed batch whenever there are enough rows."""

    def __init__(self, n: int, rows: int = 1 << 19) -> None:
        self.n, self.rows, self.held, self.size = n, rows, [], 0

    def add(self, keys: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.held.append((buckets_of(keys, self.n), *cols))
            self.size += len(keys)
        if self.size >= self.rows:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            bucket, *cols = [np.concatenate(c) for c in zip(*self.held)]
            self.held, self.size = [], 0
            yield pack(bucket, cols)


def payloads(batches: Iterable[pa.RecordBatch], name: str = "payload") -> Iterator[bytes]:
    for b in batches:
        yield from b.column(name).to_pylist()


def spread(df: DataFrame, n: int) -> DataFrame:
    """Send each row to the partition that its ``bucket`` names."""
    return df.repartitionById(n, F.col("bucket"))


# -- frames ----------------------------------------------------------------------------------


#: Bytes of input that a partition of an exchange is for, where the session asks for too few partitions.
PART_BYTES = 64 << 20


def parts(docs: DataFrame) -> int:
    """Partitions of an exchange over ``docs``: what the session sets, or more where these would be large."""
    asked = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(docs)
    return asked if size is None else max(asked, -(-size // PART_BYTES))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact name, whatever other columns the frame has."""
    ship(df.sparkSession)
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread_over_cores(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
