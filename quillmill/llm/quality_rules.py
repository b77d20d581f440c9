"""Rule bitmask ledger: every quality rule is evaluated once and stored as a bit.

``ledger`` scans the texts once and writes the measurements and one BIGINT of failure bits for each
document to the shared folder.  Policies are versioned masks over those bits: ``apply_policies`` adds
their verdicts and ``ablation`` counts what each rule removes, by ``bits & mask`` and sums over the few
different bit patterns.  Both read the stored ledger and never a text, and the registered queries of one
session share one ledger as long as the files of the table are the same.

Cases: a null text is measured as the empty text; an empty text fails ``too_short`` (its ratios
are 0); texts of any length are measured whole; repeated rows give repeated ledger rows; a null doc_id
is kept as null; values on a rule's limit pass it; an empty table gives an empty ledger; other columns,
of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from . import core

#: (name, measurement, SQL condition of failure); a rule's place is its bit and never changes.
RULES = [
    ("too_short", "n_words", "n_words < 3"),
    ("too_long", "n_words", "n_words > 200000"),
    ("word_length_low", "mean_word_length", "n_words >= 3 AND mean_word_length < 2"),
    ("word_length_high", "mean_word_length", "mean_word_length > 16"),
    ("symbol_heavy", "symbol_ratio", "symbol_ratio > 0.1"),
    ("shouting", "upper_ratio", "n_words >= 10 AND upper_ratio > 0.5"),
    ("few_letters", "letter_ratio", "n_words >= 3 AND letter_ratio < 0.5"),
    ("exclaiming", "exclaim_ratio", "n_words >= 10 AND exclaim_ratio > 0.2"),
    ("repeated_lines", "repeated_line_ratio", "n_lines >= 4 AND repeated_line_ratio > 0.3"),
    ("bullet_lines", "bullet_line_ratio", "n_lines >= 4 AND bullet_line_ratio > 0.9"),
    ("ellipsis_lines", "ellipsis_line_ratio", "n_lines >= 4 AND ellipsis_line_ratio > 0.3"),
    ("digit_heavy", "digit_ratio", "n_words >= 10 AND digit_ratio > 0.2"),
]

#: Versioned policies: the rules whose failure removes a document.
POLICIES = {
    "lenient_v1": ["too_short", "symbol_heavy", "shouting", "few_letters", "exclaiming"],
    "web_v2": [name for name, _, _ in RULES],
}

BIT = {name: 1 << i for i, (name, _, _) in enumerate(RULES)}

_MEASURED = [
    "n_chars", "n_words", "n_lines", "mean_word_length", "symbol_ratio", "upper_ratio", "letter_ratio",
    "exclaim_ratio", "repeated_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "digit_ratio",
]
_BITS = " + ".join(f"(CASE WHEN {cond} THEN CAST({1 << i} AS BIGINT) ELSE 0 END)" for i, (_, _, cond) in enumerate(RULES))
_RATIO = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE CAST(0 AS DOUBLE) END AS {2}"


def _ratios() -> list[str]:
    return [
        _RATIO.format("n_solid", "n_words", "mean_word_length"),
        _RATIO.format("n_symbols", "n_words", "symbol_ratio"),
        _RATIO.format("n_upper", "n_letters", "upper_ratio"),
        _RATIO.format("n_alpha", "n_solid", "letter_ratio"),
        _RATIO.format("n_exclaim", "n_words", "exclaim_ratio"),
        _RATIO.format("(n_lines - n_distinct_lines)", "n_lines", "repeated_line_ratio"),
        _RATIO.format("n_bullets", "n_lines", "bullet_line_ratio"),
        _RATIO.format("n_ellipses", "n_lines", "ellipsis_line_ratio"),
        _RATIO.format("n_digits", "n_solid", "digit_ratio"),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """One row for each document: measurements and ``fail_bits``."""
    base = core.pick(docs, "doc_id", "text").select("doc_id", F.expr("coalesce(text, '') AS text"))
    counted = base.selectExpr(
        "doc_id",
        "CAST(length(text) AS BIGINT) AS n_chars",
        "CAST(regexp_count(text, '[^ \\\\t\\\\r\\\\n]+') AS BIGINT) AS n_words",
        "CAST(length(text) - length(translate(text, ' \\t\\r\\n', '')) AS BIGINT) AS n_blank",
        "CAST(regexp_count(text, '[#$%&*|<>{}\\\\\\\\^~]+') AS BIGINT) AS n_symbols",
        "CAST(regexp_count(text, '[A-Z]') AS BIGINT) AS n_upper",
        "CAST(regexp_count(text, '[a-z]') AS BIGINT) AS n_lower",
        "CAST(regexp_count(text, '!') AS BIGINT) AS n_exclaim",
        "CAST(regexp_count(text, '[0-9]') AS BIGINT) AS n_digits",
        "CAST(regexp_count(text, '[!-@\\\\[-`{-~]') AS BIGINT) AS n_marks",
        "filter(split(text, '\\n'), x -> trim(x) <> '') AS lines",
    )
    shaped = counted.selectExpr(
        "*",
        "n_chars - n_blank AS n_solid",
        "n_upper + n_lower AS n_letters",
        "n_chars - n_blank - n_marks AS n_alpha",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        "CAST(size(array_distinct(lines)) AS BIGINT) AS n_distinct_lines",
        "CAST(size(filter(lines, x -> substring(ltrim(x), 1, 1) IN ('-', '*', '+', '|'))) AS BIGINT) AS n_bullets",
        "CAST(size(filter(lines, x -> rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS BIGINT) AS n_ellipses",
    ).drop("lines")
    return shaped.selectExpr("doc_id", "n_chars", "n_words", "n_lines", *_ratios()).selectExpr("doc_id", *_MEASURED, f"{_BITS} AS fail_bits")


def ledger(docs: DataFrame) -> DataFrame:
    """``measured``, written once to the shared folder and read from there."""
    return core.kept(measured(docs), "ledger")


#: The last ledger, with the session and the files that it is of.
_last: tuple[tuple, DataFrame] | None = None


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of each of a table's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the table ``documents``; the texts are read only if this session hasn't stored that of the same files."""
    global _last
    of = (spark, spark.sparkContext.applicationId, shared_folder(spark), _files(spark, f"{sf_dir}/documents.parquet"))
    if _last is None or _last[0] != of:
        _last = (of, ledger(core.table(spark, sf_dir, "documents")))
    return _last[1]


def mask_of(rules: Iterable[str]) -> int:
    """The bits of a policy's rules; an unknown rule is an error."""
    return sum(BIT[r] for r in set(rules))


def apply_policies(led: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """The ledger with ``keep_<policy>`` of each policy (name: rules whose failure removes a document)."""
    policies = POLICIES if policies is None else policies
    return led.selectExpr("*", *[f"(fail_bits & {mask_of(rules)}) = 0 AS `keep_{p}`" for p, rules in policies.items()])


def ablation(led: DataFrame, policies: dict[str, list[str]] | None = None) -> DataFrame:
    """What each policy's rules remove: documents failing, failing only it, and kept without it."""
    spark, policies = led.sparkSession, POLICIES if policies is None else policies
    patterns = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = spark.createDataFrame(
        [(p, r, mask_of(names), BIT[r]) for p, names in policies.items() for r in names], "policy string, rule string, mask bigint, bit bigint"
    )
    return (
        patterns.crossJoin(F.broadcast(rules))
        .groupBy("policy", "rule")
        .agg(
            F.expr("sum(CASE WHEN fail_bits & bit <> 0 THEN n ELSE 0 END) AS n_failing"),
            F.expr("sum(CASE WHEN fail_bits & mask = bit THEN n ELSE 0 END) AS n_only_this"),
            F.expr("sum(CASE WHEN fail_bits & (mask - bit) = 0 THEN n ELSE 0 END) AS n_kept_without"),
        )
    )


_LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"


def _len_of(cls: str) -> str:
    return f"CAST(length(text) - length(regexp_replace(text, '{cls}', '', 'g')) AS BIGINT)"


LEDGER_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
counted AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
  CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS BIGINT) AS n_words,
  {_len_of("[ \\t\\r\\n]")} AS n_blank,
  CAST(len(regexp_extract_all(text, '[#$%&*|<>{{}}\\\\^~]+')) AS BIGINT) AS n_symbols,
  {_len_of("[A-Z]")} AS n_upper, {_len_of("[a-z]")} AS n_lower, {_len_of("!")} AS n_exclaim,
  {_len_of("[0-9]")} AS n_digits, {_len_of("[!-@\\[-`{-~]")} AS n_marks, {_LINES} AS lines FROM base),
shaped AS (SELECT *, n_chars - n_blank AS n_solid, n_upper + n_lower AS n_letters, n_chars - n_blank - n_marks AS n_alpha,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(list_distinct(lines)) AS BIGINT) AS n_distinct_lines,
  CAST(len(list_filter(lines, lambda x: substring(ltrim(x), 1, 1) IN ('-', '*', '+', '|'))) AS BIGINT) AS n_bullets,
  CAST(len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS BIGINT) AS n_ellipses FROM counted),
measured AS (SELECT doc_id, n_chars, n_words, n_lines, {", ".join(_ratios())} FROM shaped),
ledger AS (SELECT doc_id, {", ".join(_MEASURED)}, {_BITS} AS fail_bits FROM measured)
"""

ORACLE = LEDGER_SQL + "SELECT *, " + ", ".join(f"(fail_bits & {m}) = 0 AS keep_{p}" for p, m in ((p, mask_of(rules)) for p, rules in POLICIES.items())) + " FROM ledger"
ABLATION_ORACLE = (
    LEDGER_SQL
    + ", rules(policy, rule, mask, bit) AS (VALUES "
    + ", ".join(f"('{p}', '{r}', CAST({mask_of(names)} AS BIGINT), CAST({BIT[r]} AS BIGINT))" for p, names in POLICIES.items() for r in names)
    + ") SELECT policy, rule, CAST(sum(CASE WHEN fail_bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failing,"
    " CAST(sum(CASE WHEN fail_bits & mask = bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only_this,"
    " CAST(sum(CASE WHEN fail_bits & (mask - bit) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept_without"
    " FROM ledger CROSS JOIN rules GROUP BY policy, rule"
)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policies(stored_ledger(spark, sf_dir))


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(stored_ledger(spark, sf_dir))
