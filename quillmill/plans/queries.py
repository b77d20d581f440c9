"""Registered queries of the text operators, and the same in DuckDB SQL."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, spans, text as T
from ..operators import align, chunking, pinning, ranker, report, rules, verify as V
from ..shipping import ship
from ..storage import pieces, spread_over_cores
from . import api

RATE, LOW_RATE, CASCADE_RATE = 0.5, 0.33, 0.45


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang) of all documents."""
    return spread_over_cores(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


# -- SQL parts ---------------------------------------------------------------------------------


def _in(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(words)) + ")"


def _esc(p: str) -> str:
    return p.replace("'", "''")


_PRIORITY = "CASE " + " ".join(f"WHEN core IN {_in(r.words)} THEN {r.priority}" for r in lexicon.ENGLISH.rules if isinstance(r, lexicon.WordClassRule)) + " END"
_URL = spans.URL.removeprefix("(?U)")
_CODE = spans.INLINE_CODE.replace("\n", r"\n")


def _rewritten(column: str) -> str:
    for p, by in lexicon.PLEASANTRIES:
        column = f"regexp_replace({column}, '{_esc(p)}', '{by}', 'gi')"
    return column


_WORDS = rf"""
w0 AS (SELECT doc_id, lang, len(regexp_extract_all(text, '\S+')) AS before, {_rewritten("text")} AS work FROM documents),
w AS (SELECT doc_id, lang, before, len(ws) AS n_words, unnest(ws) AS word, unnest(gs) AS gap, generate_subscripts(ws, 1) - 1 AS pos FROM
  (SELECT *, regexp_extract_all(work, '(\s*)(\S+)', 2) AS ws, regexp_extract_all(work, '(\s*)(\S+)', 1) AS gs FROM w0)),
c AS (SELECT *, lower(regexp_extract(word, '(\pL(?:\pL|'')*)', 1)) AS core, regexp_matches(word, '{_URL}') AS url, regexp_matches(word, '[\d]') OR regexp_matches(word, '{_URL}') AS digit FROM w),
b AS (SELECT *, {_PRIORITY} AS priority,
  NOT digit AND coalesce(max(digit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1
  AND coalesce(max(digit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1 AS bridge FROM c),
cand AS (SELECT * FROM b WHERE priority IS NOT NULL AND NOT bridge AND NOT digit AND NOT regexp_matches(word, '^[#>|]|[.!?:]["'')\]]*$') AND core NOT LIKE '%n''t' AND core NOT IN {_in(lexicon.NEGATIONS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, pos) AS rank FROM cand)
"""


def _tidied(column: str) -> str:
    for p, by in T.TIDY:
        flags = "'gm'" if p.startswith("(?m)") else "'g'"
        column = f"regexp_replace({column}, '{_esc(p.removeprefix('(?m)'))}', '{by.replace('$', chr(92))}', {flags})"
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


_CHECK_WORDS = r"regexp_extract_all(lower({}), '\pL+(?:''\pL+)?')"
_LETTER = r"[\pL\pN\pM_]"


# -- queries -----------------------------------------------------------------------------------


def token_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.count_tokens(F.col("text")).cast("bigint").alias("n_tokens"))


def core_words(spark, sf_dir):
    words = documents(spark, sf_dir).select(F.explode(T.words(F.col("text"))).alias("w")).select(T.core(F.col("w")).alias("core"))
    return words.where("core <> ''").groupBy("core").agg(F.count("*").alias("n"))


def rule_nominations(spark, sf_dir):
    pack = lexicon.ENGLISH
    words = documents(spark, sf_dir).select("lang", F.explode(T.words(F.col("text"))).alias("w")).select("lang", T.core(F.col("w")).alias("core"))
    return words.withColumn("priority", lexicon.priority(F.col("core"), pack.rules)).where("priority IS NOT NULL").groupBy("lang", "priority").agg(F.count("*").alias("n"))


def rules_drop_set(spark, sf_dir):
    return rules.drops(documents(spark, sf_dir), RATE).selectExpr("doc_id", "CAST(pos AS BIGINT) AS pos", "word", "priority", "CAST(rank AS BIGINT) AS rank", "dropped")


def rules_compress_text(spark, sf_dir):
    return rules.compress(documents(spark, sf_dir), RATE).selectExpr("doc_id", "compressed", "CAST(compressed_dropped AS BIGINT) AS dropped")


def rate_sweep(spark, sf_dir):
    """All rates from one ranking: a word goes at each rate whose budget its rank still exceeds."""
    docs = documents(spark, sf_dir)
    rates = F.array(*[F.lit(r) for r in report.RATES])
    ranked = rules.ranked(docs.select("doc_id", "lang", "text"), keep=("lang",))
    gone = ranked.select("lang", F.explode(F.filter(rates, lambda r: rules.goes(r))).alias("rate")).groupBy("lang", "rate").agg(F.count("*").alias("dropped"))
    n = docs.groupBy("lang").agg(F.sum(T.count_tokens(F.col("text"))).alias("n_tokens")).select("lang", "n_tokens", F.explode(rates).alias("rate"))
    return n.join(gone, ["lang", "rate"], "left").select("lang", "n_tokens", F.coalesce("dropped", F.lit(0)).alias("dropped"), "rate")


def phrase_rewrites(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    return talk.select("conv_id", "turn", lexicon.ENGLISH.rules["pleasantries"].rewrite(F.col("text")).alias("rewritten"))


def negation_counts(spark, sf_dir):
    return V.negation_counts(documents(spark, sf_dir))


def number_counts(spark, sf_dir):
    return V.number_counts(documents(spark, sf_dir))


def _selected(docs: DataFrame) -> DataFrame:
    """Each document as selection by length leaves it in a language that names no negations."""
    bare = lexicon.Language("bare", lexicon.RuleSet())
    return ranker.select(docs, LOW_RATE, language=bare).select("doc_id", F.col("compressed").alias("text"))


def negations_lost(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return V.lost(V.negation_counts(docs), V.negation_counts(_selected(docs)), "doc_id", "cue")


def numbers_lost(spark, sf_dir):
    docs = documents(spark, sf_dir)
    small = rules.compress(docs, LOW_RATE).select("doc_id", F.col("compressed").alias("text"))
    return V.lost(V.number_counts(docs), V.number_counts(small), "doc_id", "number")


def negation_pileups(spark, sf_dir):
    return align.pileups(documents(spark, sf_dir))


def ranker_select(spark, sf_dir):
    done = ranker.select(documents(spark, sf_dir), LOW_RATE)
    return done.selectExpr("doc_id", "compressed", "CAST(compressed_dropped AS BIGINT) AS dropped")


def ranker_idf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return ranker.select(docs, LOW_RATE, scorer=ranker.idf_scorer(docs)).selectExpr("doc_id", "compressed", "CAST(compressed_dropped AS BIGINT) AS compressed_dropped")


def cascade(spark, sf_dir):
    done = ranker.cascade(documents(spark, sf_dir), CASCADE_RATE)
    return done.selectExpr("doc_id", "compressed", "CAST(compressed_dropped AS BIGINT) AS compressed_dropped", "compressed_rules_ratio", "compressed_inner")


def sentences(spark, sf_dir):
    ship(spark)

    @F.pandas_udf("int")
    def count(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(chunking.split_sentences(t)) if t is not None else 0)

    return documents(spark, sf_dir).select("doc_id", count("text").cast("bigint").alias("n_sentences"))


def hard_split_bins(spark, sf_dir):
    """The chunker's hard split of whole texts: words of each piece."""
    ship(spark)

    def run(batches):
        for b in batches:
            pieces = [chunking._bins(t.split(), chunking.MAX_TOKENS) if t else [] for t in b.column("text").to_pylist()]
            rows = [(d, k, len(p.split())) for d, ps in zip(b.column("doc_id").to_pylist(), pieces) for k, p in enumerate(ps)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "bin", "n_words"])

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id bigint, bin bigint, n_words bigint")


def chunk_documents(spark, sf_dir):
    rows = chunking.chunk_rows(documents(spark, sf_dir), "doc_id", "text")
    return rows.select(F.col("_key").alias("doc_id"), F.col("_n").alias("chunk"), F.col("_raw").alias("text"), F.col("_body").isNotNull().alias("compressible"), F.size("_spans").alias("n_spans"))


def protect_roundtrip(spark, sf_dir):
    """Pages with their spans behind placeholders and back, and how many spans of the first two kinds there were."""
    ship(spark)
    placeholder = re.compile(spans.PLACEHOLDER.replace(r"\d", "[0-9]"))

    def row(html):
        if html is None:
            return None, None, None, True
        text, stash, counts = html, [], []
        for p in (spans.INLINE_CODE, spans.URL, spans.IDENTIFIER, spans.COMPOUND_NUMBER):
            text = spans.protected(text, stash, p, "c")
            counts.append(len(stash))
        return spans.restored(text, stash, "c"), counts[0], counts[1], len(placeholder.findall(text)) == len(stash)

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        for b in pieces(batches):
            rows = [row(t) for t in b.column("html").to_pylist()]
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.record_batch([b.column("page_id"), *cols], names=["page_id", "restored", "n_code", "n_code_and_urls", "all_replaced"])

    pages = spread_over_cores(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, restored string, n_code bigint, n_code_and_urls bigint, all_replaced boolean")


def compress_documents(spark, sf_dir):
    return api.compress_documents(documents(spark, sf_dir), RATE, "rules").drop("backend")


def verify_warnings(spark, sf_dir):
    pairs = rules.compress(documents(spark, sf_dir), LOW_RATE)
    return V.verify_pairs(pairs, "text", "compressed")


def faithfulness_report(spark, sf_dir):
    rows = None
    for backend in ("rules", "ranker", "cascade"):
        one = api.compress_documents(documents(spark, sf_dir), LOW_RATE, backend)
        rows = one if rows is None else rows.unionByName(one)
    return report.faithfulness(rows, "backend")


def align_labels(spark, sf_dir):
    pairs = rules.compress(documents(spark, sf_dir), LOW_RATE)
    return align.annotate(pairs, "text", "compressed").drop("words", "labels")


def repair_pairs(spark, sf_dir):
    docs = documents(spark, sf_dir)
    pairs = ranker.select(docs, LOW_RATE).select("doc_id", F.col("text").alias("original"), "compressed")
    return pinning.repair(pairs, ("n't", *sorted(lexicon.NEGATIONS)))


def filter_worst(spark, sf_dir):
    return align.filter_examples(align_labels(spark, sf_dir).where("keep_ratio IS NOT NULL"))


def qa_scores(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("answer"))
    return report.qa_scores(talk.where("answer IS NOT NULL").withColumn("prediction", report.stub_answer(F.col("answer"))), "role").select("role", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "n")


def detok(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.repair_detokenization(F.col("text")).alias("repaired"))


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, core_words, rule_nominations, rules_drop_set, rules_compress_text, rate_sweep, phrase_rewrites, negation_counts, number_counts, negations_lost,
        numbers_lost, negation_pileups, ranker_select, ranker_idf, cascade, sentences, hard_split_bins, chunk_documents, protect_roundtrip, compress_documents,
        verify_warnings, faithfulness_report, align_labels, repair_pairs, filter_worst, qa_scores, detok,
    )
}

_NEG = f"CASE WHEN x LIKE '%n''t' THEN 'n''t' ELSE x END"
_NEG_OK = f"(x LIKE '%n''t' OR x IN {_in(lexicon.NEGATIONS)})"
_NEG_COUNTS = f"SELECT doc_id, {_NEG} AS cue, count(*) AS n FROM (SELECT doc_id, unnest({_CHECK_WORDS.format('text')}) AS x FROM {{}}) WHERE {_NEG_OK} GROUP BY ALL"
# Doubled separators stand for the look-around: each number has its own neighbours.
_NUM_COUNTS = (
    rf"SELECT doc_id, replace(lower(x), ',', '') AS number, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all("
    rf"regexp_replace(' ' || text || ' ', '([^\pL\pN\pM_.,])', '\1\1', 'g'), '[^\pL\pN\pM_.]([vV]?\d+(?:[.,]\d+)*%?)(?:[^\pL\pN\pM_])', 1)) AS x FROM {{}}) GROUP BY ALL"
)
_MARKS = T.EDGE_MARKS.replace("'", "''")
_ANSWER = r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"

_NEG_PIN = f"core LIKE '%n''t' OR core IN {_in(lexicon.NEGATIONS)}"


def _selection(pinned: str, docs: str = "documents", rate: str = f"CAST({LOW_RATE} AS DOUBLE)", order: str = "len(core) DESC", more: str = "", ranked: str = "p") -> str:
    """``selected`` (doc_id, compressed, dropped) of ``docs`` (doc_id, text); ``more`` may make ``ranked`` of p."""
    return rf"""u AS (SELECT doc_id, {rate} AS keep, len(us) AS n, unnest(us) AS w, generate_subscripts(us, 1) - 1 AS pos FROM (SELECT *, regexp_extract_all(text, '\n+|\S+') AS us FROM {docs})),
c1 AS (SELECT *, lower(trim(w, '{_MARKS}')) AS core FROM u),
p AS (SELECT *, regexp_matches(w, '^[\n#>|]') OR {pinned} OR core = '' OR regexp_matches(w, '(^|[^\pL\pN\pM_.])[vV]?\d+([.,]\d+)*%?($|[^\pL\pN\pM_])') AS pin FROM c1),
{more}r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pin ORDER BY {order}, pos) AS rank, greatest(1, least(n, CAST(round_even(keep * n, 0) AS BIGINT))) - count(*) FILTER (pin) OVER (PARTITION BY doc_id) AS room FROM {ranked}),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) FILTER (pin OR rank <= room) AS t, count(*) FILTER (NOT (pin OR rank <= room)) AS dropped FROM r GROUP BY doc_id),
selected AS (SELECT d.doc_id, CASE WHEN k.doc_id IS NULL THEN d.text ELSE regexp_replace(t, ' ?(\n+) ?', '\1', 'g') END AS compressed, CASE WHEN d.text IS NOT NULL THEN coalesce(dropped, 0) END AS dropped FROM {docs} d LEFT JOIN k USING (doc_id))"""


def _by_rules(rate: float) -> str:
    return f"""{_WORDS}, gone AS (SELECT doc_id, pos FROM ranked WHERE n_words - (rank - 1) > before * CAST({rate} AS DOUBLE)),
kept AS (SELECT b.doc_id, string_agg(gap || CASE WHEN g.pos IS NULL THEN word ELSE '' END, '' ORDER BY b.pos) AS t, count(g.pos) AS dropped FROM b LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.pos = b.pos GROUP BY b.doc_id),
by_rules AS (SELECT d.doc_id, CASE WHEN k.t IS NULL THEN d.text ELSE {_tidied("k.t")} END AS compressed, CASE WHEN d.text IS NOT NULL THEN coalesce(dropped, 0) END AS dropped FROM documents d LEFT JOIN kept k USING (doc_id))"""


def _repaired(column: str) -> str:
    """Detokenisation without look-around: what two matches may share is doubled before and halved after."""
    w = r"[\pL\pN\pM_]"
    steps = [
        (rf"({w})\s+('')\s*({w})", r"\1\2\3"), (rf"({w})\s+(n''t)\b", r"\1\2"),
        (r"(\d)", r"\1¤\1"), (r"(\d)\s*([.,:/-])\s*(\d)", r"\1\2\3"), (r"(\d)¤\d", r"\1"),
        (r"\A|\z", " "), (r"([^.,\d])", r"\1\1"), (r"([^.,\d])(\d{1,3})(?:\t\t|  )+(\d{3})([^.,\d])", r"\1\2,\3\4"), (r"([^.,\d])[^.,\d]", r"\1"), (r"\A | \z", ""),
        (r"(\d)\s+(%)", r"\1\2"), (r"([¥£€$])\s+(\d)", r"\1\2"), (r"\s+([])}%?!:;.,])", r"\1"), (r"([$\[({])\s+", r"\1"), (r"\s+(''s)\b", r"\1"),
        (r"[\t ]{2,}", " "), (r"[\t ]*\n[\t ]*", "\n"), (r"\n\n\n+", "\n\n"), (r"\A\s+|\s+\z", ""),
    ]
    for pattern, by in steps:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'gs')"
    return column


_ENDING = r"""([\pL\pN\pM]*(?:\.[\pL\pN\pM]*)*)([.!?]+["'')\]]*)\s+"""


def _lost(key: str, counts: str, small: str, source: str) -> str:
    return f"""WITH {small}, small AS (SELECT doc_id, compressed AS text FROM {source}), had AS ({counts.format("documents")}), has AS ({counts.format("small")})
SELECT had.doc_id, had.{key}, had.n, coalesce(has.n, 0) AS kept FROM had LEFT JOIN has ON had.doc_id = has.doc_id AND had.{key} = has.{key} WHERE coalesce(has.n, 0) < had.n"""


ORACLES = {
    "token_counts": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_tokens FROM documents",
    "core_words": r"SELECT core, count(*) AS n FROM (SELECT lower(regexp_extract(w, '(\pL(?:\pL|'')*)', 1)) AS core FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM documents)) WHERE core <> '' GROUP BY core",
    "rule_nominations": rf"SELECT lang, CAST({_PRIORITY} AS DOUBLE) AS priority, count(*) AS n FROM (SELECT lang, lower(regexp_extract(w, '(\pL(?:\pL|'')*)', 1)) AS core FROM (SELECT lang, unnest(regexp_extract_all(text, '\S+')) AS w FROM documents)) WHERE {_PRIORITY} IS NOT NULL GROUP BY ALL",
    "rules_drop_set": f"WITH {_WORDS} SELECT doc_id, pos, word, CAST(priority AS DOUBLE) AS priority, rank, n_words - (rank - 1) > before * CAST({RATE} AS DOUBLE) AS dropped FROM ranked",
    "rules_compress_text": f"WITH {_by_rules(RATE)} SELECT doc_id, compressed, dropped FROM by_rules",
    "rate_sweep": f"""WITH {_WORDS}, r AS (SELECT unnest([{", ".join(map(str, report.RATES))}]) AS rate),
g AS (SELECT lang, CAST(rate AS DOUBLE) AS rate, count(*) AS dropped FROM ranked, r WHERE n_words - (rank - 1) > before * CAST(rate AS DOUBLE) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_tokens FROM documents GROUP BY lang)
SELECT n.lang, n_tokens, coalesce(dropped, 0) AS dropped, CAST(r.rate AS DOUBLE) AS rate FROM n CROSS JOIN r LEFT JOIN g ON g.lang = n.lang AND g.rate = CAST(r.rate AS DOUBLE)""",
    "phrase_rewrites": f"SELECT conv_id, turn, {_rewritten('text')} AS rewritten FROM conversations",
    "negation_counts": _NEG_COUNTS.format("documents"),
    "number_counts": _NUM_COUNTS.format("documents"),
    "negations_lost": _lost("cue", _NEG_COUNTS, _selection("false"), "selected"),
    "numbers_lost": _lost("number", _NUM_COUNTS, _by_rules(LOW_RATE), "by_rules"),
    "negation_pileups": rf"""WITH w AS (SELECT doc_id, trim(unnest(ws), '.,;:!?') AS x, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS ws FROM documents)),
g AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM w WHERE {_NEG_OK}), n AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT doc_id, max(n) AS longest FROM n GROUP BY doc_id""",
    # The rarer a word is, the higher is its score: the order by document counts is the order by scores.
    "ranker_idf": "WITH "
    + _selection(
        _NEG_PIN, order="df", ranked="rare",
        more="freq AS (SELECT core, count(DISTINCT doc_id) AS df FROM c1 WHERE w NOT LIKE chr(10) || '%' GROUP BY core), rare AS (SELECT p.*, coalesce(f.df, 1) AS df FROM p LEFT JOIN freq f ON f.core = p.core), ",
    )
    + " SELECT doc_id, compressed, dropped AS compressed_dropped FROM selected",
    "cascade": f"""WITH {_by_rules(0.33)},
first AS MATERIALIZED (SELECT b.doc_id, b.compressed AS text, b.dropped AS gone, d.text AS original,
  greatest(CAST(0.000001 AS DOUBLE), CAST(len(regexp_extract_all(b.compressed, '\\S+')) AS DOUBLE) / greatest(1, len(regexp_extract_all(d.text, '\\S+')))) AS survived FROM by_rules b JOIN documents d ON d.doc_id = b.doc_id),
inner_ AS (SELECT *, least(CAST(1 AS DOUBLE), CAST({CASCADE_RATE} AS DOUBLE) / survived) AS rest FROM first),
{_selection(_NEG_PIN, docs="inner_", rate="rest")}
SELECT i.doc_id, CASE WHEN regexp_full_match(original, '\\s*') THEN original WHEN rest >= 1 THEN i.text ELSE compressed END AS compressed,
  gone + CASE WHEN rest >= 1 THEN 0 ELSE dropped END AS compressed_dropped, round(survived, 4) AS compressed_rules_ratio, round(rest, 4) AS compressed_inner
FROM inner_ i JOIN selected s ON s.doc_id = i.doc_id""",
    "ranker_select": f"WITH {_selection(_NEG_PIN)} SELECT doc_id, compressed, dropped FROM selected",
    "hard_split_bins": rf"SELECT doc_id, CAST(floor(pos / {chunking.MAX_TOKENS}) AS BIGINT) AS bin, count(*) AS n_words FROM (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS ws FROM documents)) GROUP BY ALL",
    # The word before each mark that a blank follows decides whether a sentence ends there.
    "sentences": rf"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_ENDING}', 1) AS ws, regexp_extract_all(text, '{_ENDING}', 2) AS ms FROM documents),
n AS (SELECT doc_id, text, list_transform(range(1, len(ws) + 1), lambda i: NOT ((ms[i][1] = '.' OR ends_with(ws[i], '.')) AND (lower(rtrim(ws[i], '.')) IN {_in(chunking._ABBREVIATIONS)} OR regexp_full_match(rtrim(ws[i], '.'), '\pL')))) AS ends FROM m)
SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 WHEN regexp_full_match(text, '\s*') THEN 1 ELSE len(list_filter(ends, lambda x: x))
  + CASE WHEN len(ends) > 0 AND ends[len(ends)] AND regexp_matches(text, '[.!?]["'')\]]*\s+\z') THEN 0 ELSE 1 END END AS BIGINT) AS n_sentences FROM n""",
    "detok": f"SELECT doc_id, {_repaired('text')} AS repaired FROM documents",
    "protect_roundtrip": rf"""WITH c AS (SELECT page_id, html, regexp_extract_all(html, '{_CODE}') AS codes, regexp_replace(html, '{_CODE}', 'QMSPANc0X', 'g') AS t FROM pages),
v AS (SELECT *, CAST(len(codes) AS BIGINT) AS n_code, len(list_filter(regexp_extract_all(t, '{_URL}'), lambda x: NOT contains(upper(x), 'QMSPAN'))) AS n_urls FROM c)
SELECT page_id, html AS restored, n_code, n_code + n_urls AS n_code_and_urls, true AS all_replaced FROM v""",
    "qa_scores": rf"""WITH t AS (SELECT role, array_to_string(regexp_extract_all(text, '\S+')[1:4], ' ') AS prediction, text AS answer FROM conversations WHERE text IS NOT NULL),
n AS (SELECT row_number() OVER () AS id, role, {_ANSWER.format("prediction")} AS p, {_ANSWER.format("answer")} AS g FROM t),
s AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS ps, list_filter(string_split(g, ' '), lambda x: x <> '') AS gs FROM n),
f AS (SELECT *, CASE WHEN len(ps) = 0 OR len(gs) = 0 THEN CAST(len(ps) = len(gs) AS DOUBLE) ELSE
  (SELECT coalesce(sum(least(len(list_filter(ps, lambda y: y = v)), len(list_filter(gs, lambda y: y = v)))), 0) FROM (SELECT unnest(list_distinct(ps)) AS v)) * CAST(2 AS DOUBLE) / (len(ps) + len(gs)) END AS f1 FROM s)
SELECT role, round(avg(CAST(p = g AS DOUBLE)), 6) AS exact_match, round(avg(f1), 6) AS f1, count(*) AS n FROM f GROUP BY role""",
}
