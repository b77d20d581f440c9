"""External merge of locally sorted capture runs into globally ordered capture histories.

Every map task writes a run of index entries sorted by (URL key, timestamp, page_id, url, digest) to
the shared folder; no page body travels.  Runs are then cut at common boundaries of that whole order, so
the captures of a hot URL lie in as many ranges as they fill, and each range merges its pieces of the
runs with a loser tree, taking from the winning run every entry that precedes the runner-up at once.
Each range numbers what it has; one row a range (its first and last key and their captures), summed in
order, turns places into global ranks and carries a history from range to range.

URL key: lower case, without scheme, ``www.``, default port, fragment, ``utm_*`` parameters and a
closing slash, host labels reversed (``com,example,blog)/en/1``).
Cases: a null url has the key ``''`` and sorts first, as do null timestamps within a key; equal
(key, timestamp) are ordered by page_id, then url, nulls first; repeated rows stay; a null body has
a null digest, which never counts as a revisit; bodies and urls of any length are read whole; an empty
table gives an empty result; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import core

_SCHEMA = "range_id int, place bigint, at_first boolean, url_key string, capture_ts bigint, page_id bigint, url string, digest string, capture_seq bigint, prev_ts bigint, is_revisit boolean"


def url_key_sql(url: str) -> str:
    """The key as SQL that both Spark and DuckDB run (``G`` marks DuckDB's global flag)."""
    bare = f"regexp_replace(regexp_replace(lower(coalesce({url}, '')), '#.*$', ''), '^[a-z][a-z0-9+.-]*://', '')"
    bare = f"regexp_replace(regexp_replace({bare}, 'utm_[a-z]+=[^&]*&?', ''G), '[?&]+$', '')"
    bare = f"regexp_replace({bare}, '^www[0-9]*[.]', '')"
    host = f"regexp_replace(regexp_extract({bare}, '^[^/?]*', 0), ':(80|443)$', '')"
    rest = f"regexp_replace(regexp_replace({bare}, '^[^/?]*', ''), '/$', '')"
    return f"CASE WHEN {host} = '' THEN '' ELSE concat(HOST({host}), ')', {rest}) END"


def _spark(sql: str) -> str:
    return sql.replace("''G", "''").replace("HOST(", "rev_host(")


class LoserTree:
    """A tournament over k sorted runs: ``winner`` holds the least head, inner nodes the losers."""

    def __init__(self, heads: list) -> None:
        self.k = max(1, len(heads))
        self.heads = heads
        self.loser = [-1] * self.k
        if heads:
            self.winner = self._build(1)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def replace(self, head) -> None:
        """Give the winner's run its next head and replay its path."""
        run = self.winner
        self.heads[run] = head
        node = (run + self.k) // 2
        while node >= 1:
            if self._less(self.loser[node], run):
                self.loser[node], run = run, self.loser[node]
            node //= 2
        self.winner = run

    def runner_up(self) -> int:
        """The best of those that lost to the winner, or -1."""
        best, node = -1, (self.winner + self.k) // 2
        while node >= 1:
            if best < 0 or self._less(self.loser[node], best):
                best = self.loser[node]
            node //= 2
        return best


def merge_runs(runs: list[list]) -> Iterator:
    """All entries of the sorted runs in order; equal entries in the order of the runs."""
    runs = [r for r in runs if r]
    if not runs:
        return
    tree, at = LoserTree([r[0] for r in runs]), [0] * len(runs)
    while tree.heads[tree.winner] is not None:
        w = tree.winner
        rival = tree.runner_up()
        run, i = runs[w], at[w]
        if rival < 0 or tree.heads[rival] is None:
            j = len(run)
        else:
            j = i + 1
            if j < len(run) and (run[j], w) < (tree.heads[rival], rival):
                j = bisect_right(run, (tree.heads[rival]), j) if w < rival else _before(run, tree.heads[rival], j)
        yield from run[i:j]
        at[w] = j
        tree.replace(run[j] if j < len(run) else None)


def _before(run: list, head, lo: int) -> int:
    from bisect import bisect_left

    return bisect_left(run, head, lo)


_LOW = (0, 0)


def _orderable(x):
    """Nulls first."""
    return _LOW if x is None else (1, x)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    range_id = TaskContext.get().partitionId()
    runs: dict[int, list] = {}
    for b in batches:
        cols = [b.column(n).to_pylist() for n in ("run_id", "url_key", "capture_ts", "page_id", "url", "digest")]
        for run, key, ts, page, url, digest in zip(*cols):
            runs.setdefault(run, []).append((key, _orderable(ts), _orderable(page), _orderable(url), _orderable(digest)))
    rows, before, seq, place, at_first = [], None, 0, 0, True

    def batch() -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    value = lambda x: None if x == _LOW else x[1]
    for entry in merge_runs([runs[k] for k in sorted(runs)]):
        key, ts, page, url, digest = entry
        same = before is not None and before[0] == key
        seq = seq + 1 if same else 1
        at_first = at_first and (same or before is None)
        d = value(digest)
        rows.append((range_id, place, at_first, key, value(ts), value(page), value(url), d, seq, value(before[1]) if same else None, bool(same and d is not None and before[4] == digest)))
        before, place = entry, place + 1
        if len(rows) == 20000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def capture_histories(pages: DataFrame) -> DataFrame:
    """Columns page_id, url, html and capture_ts (seconds) give globally ordered histories."""
    spark = pages.sparkSession
    key = url_key_sql("url").replace("''G", "''")
    host = key[key.index("HOST(") + 5 : key.rindex("), ')',")]
    key = key.replace(f"HOST({host})", f"array_join(reverse(split({host}, '[.]')), ',')")
    entries = core.pick(pages, "page_id", "url", "html", "capture_ts").selectExpr(
        "spark_partition_id() AS run_id", f"{key} AS url_key", "CAST(capture_ts AS BIGINT) AS capture_ts", "CAST(page_id AS BIGINT) AS page_id", "url", "md5(html) AS digest"
    )
    order = ["url_key", "capture_ts", "page_id", "url", "digest"]
    runs = core.kept(entries.sortWithinPartitions(*order), "runs")
    # Each range's piece of a run comes in order again, whatever the exchange did.
    ranges = runs.repartitionByRange(core.parts(runs), *order).sortWithinPartitions("run_id", *order)
    merged = core.kept(ranges.mapInArrow(core.lean(_merge), _SCHEMA), "merged")
    ends = merged.groupBy("range_id").agg(
        F.count("*").alias("n"), F.min_by("url_key", "place").alias("first_key"),
        *[F.max_by(c, "place").alias(f"last_{c}") for c in ("url_key", "capture_seq", "capture_ts", "digest")],
    )
    carried = spark.createDataFrame(_carried(ends.orderBy("range_id").collect()), "range_id int, start bigint, open boolean, seq bigint, ts bigint, body string")
    # One row a range: bounded by the number of partitions.
    joined = merged.join(F.broadcast(carried), "range_id")
    goes_on, first = F.col("open") & F.col("at_first"), F.col("open") & (F.col("place") == 0)
    return joined.select(
        (F.col("start") + F.col("place") + 1).alias("global_rank"), "url_key", F.col("capture_ts"), "page_id", "url", "digest",
        (F.col("capture_seq") + F.when(goes_on, F.col("seq")).otherwise(0)).alias("capture_seq"), F.when(first, F.col("ts")).otherwise(F.col("prev_ts")).alias("prev_ts"),
        F.when(first, F.coalesce(F.col("body") == F.col("digest"), F.lit(False))).otherwise(F.col("is_revisit")).alias("is_revisit"),
    )


def _carried(ends: list) -> list[tuple]:
    """(range, entries before it, whether its first history goes on from before, captures and last capture of that)."""
    out, start, before, seq = [], 0, None, 0
    for r in ends:
        open_ = before is not None and before.last_url_key == r.first_key
        out.append((r.range_id, start, open_, seq if open_ else 0, before.last_capture_ts if open_ else None, before.last_digest if open_ else None))
        seq = r.last_capture_seq + (seq if open_ and r.first_key == r.last_url_key else 0)
        start, before = start + r.n, r
    return out


#: The test tables carry no capture time; one is made from the page's number.
CAPTURE_TS = "1704067200 + ((page_id * 7919) % 31536000)"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = core.table(spark, sf_dir, "pages").withColumn("capture_ts", F.expr(CAPTURE_TS))
    return capture_histories(pages)


def _oracle() -> str:
    key = url_key_sql("url").replace("''G", "'', 'g'")
    host = key[key.index("HOST(") + 5 : key.rindex("), ')',")]
    key = key.replace(f"HOST({host})", f"array_to_string(list_reverse(string_split({host}, '.')), ',')")
    order = "capture_ts NULLS FIRST, page_id NULLS FIRST, url NULLS FIRST, digest NULLS FIRST"
    return f"""
WITH e AS (SELECT {key} AS url_key, {CAPTURE_TS} AS capture_ts, page_id, url, md5(html) AS digest FROM pages)
SELECT row_number() OVER (ORDER BY url_key, {order}) AS global_rank, url_key, capture_ts, page_id, url, digest,
  row_number() OVER w AS capture_seq, lag(capture_ts) OVER w AS prev_ts, coalesce(lag(digest) OVER w = digest, false) AS is_revisit
FROM e WINDOW w AS (PARTITION BY url_key ORDER BY {order})"""


ORACLE = _oracle()
