"""The registered queries of the training-data operators, and SQL for those that SQL can express.

Each query applies its operator with production parameters to the whole table and derives the
columns asked for from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing, packing, quality, rules, simhash, substring, tiff, tokens, toxicity
from .common import documents, labels


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: ``simhash.near_duplicates``, which states how nulls, ties and repeats come out."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document: ``substring.substring_report``; one row per id, null and empty texts have none."""
    return substring.substring_report(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a grammar fitted on training rows: one row per row, null and empty texts score as no evidence."""
    docs = documents(spark, sf_dir)
    grammar = toxicity.fit(docs, labels(spark, sf_dir))
    out = toxicity.score_toxicity(docs, grammar)
    return out.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses", "top_clause"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a risk over all of them: one row per row, null and empty texts are the pattern of no words."""
    out = quality.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the digest of what stays, of every document: one row per row, null is one empty line."""
    out = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows: at least one per row, as the null and the empty text have their end id."""
    return packing.pack(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document through a digest cache that is new in each call: one row per row."""
    return tokens.token_counts(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: one row per row; a null source is a source, a null text has size 0."""
    return mixing.mix_report(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdict of every document from the ledger: one row per row; null and empty texts fail ``few_words``."""
    led = rules.ledger(documents(spark, sf_dir).select("doc_id", "text"), prefix="", bits="failures")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rules.failed("failures", "base").alias("base_failed"), (~rules.failed("failures", rules.CURRENT)).alias("kept"), "failures",
    )


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through TIFF pages and back: one row per row; null is the empty text, 64 zero bytes."""
    return tiff.media_digest(documents(spark, sf_dir))


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy fails, fails alone, and what would be kept without it, over the whole table."""
    return rules.ablations(rules.ledger(documents(spark, sf_dir).select("doc_id", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages over all documents: pieces of what is kept and mixed; an empty table gives no rows."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_substring, op3_toxicity, op4_quality, op5_line_dedup, op6_packing, op7_token_counts, op8_mixing, op9_quality_rules, op10_tiff, quality_rule_ablations, pipeline)
}

#: The six ASCII white-space characters, and a class of them, as SQL string pieces.
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: The ledger in SQL, with the rules' thresholds written out.
_LEDGER = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i
  FROM d),
g AS (
  SELECT doc_id, i, w, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c, lead(w, 3) OVER p AS d, lead(w, 4) OVER p AS e, lag(w) OVER p AS before
  FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
h AS (
  SELECT *, e IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, b, c, d, e) > 1 AS twice FROM g),
c AS (
  SELECT doc_id, w, i, max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered,
         sum(CASE WHEN w = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM h),
r AS (SELECT doc_id, max(n) AS max_run FROM (SELECT doc_id, run, count(*) AS n FROM c GROUP BY doc_id, run) GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, sum(covered) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '')) AS n_letters,
         coalesce(max_run, 0) AS max_run
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > n_letters AND n_letters >= 40 THEN 32 ELSE 0 END
    + CASE WHEN max_run >= 8 THEN 64 ELSE 0 END) AS failures
  FROM m)
"""

ORACLES: dict[str, str] = {
    "op5_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op8_mixing": """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o
  FROM documents),
s AS (
  SELECT source, sum(size) AS total, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, total * 2.0::DOUBLE AS cap FROM s),
f AS (
  SELECT *, cap / weight AS ratio,
         (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w),
g AS (SELECT *, max(CASE WHEN lev <= ratio THEN lev END) OVER () AS level FROM f),
t AS (
  SELECT source, total, CASE WHEN level IS NULL OR ratio < level THEN cap ELSE level * weight END AS target FROM g),
e AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT d.doc_id, d.size, e.total, e.target, e.epochs, round(e.target - e.epochs * e.total) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, round(target, 3) AS target,
       CAST(epochs * size + greatest(0, least(size, rest - pos)) AS BIGINT) AS taken
FROM x
""",
    "op9_quality_rules": _LEDGER
    + """
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failures = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM b
""",
    "quality_rule_ablations": _LEDGER
    + """,
r2 AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'word_length', 'duplicate_lines', 'capitals', 'one_word_run']) AS rule,
              unnest([1, 2, 4, 8, 16, 32, 64]) AS bit)
SELECT rule, count(*) FILTER ((failures & bit) <> 0) AS failed, count(*) FILTER (failures = bit) AS failed_alone,
       count(*) FILTER (failures = 0) AS kept, count(*) FILTER (failures = 0 OR failures = bit) AS kept_without
FROM b, r2 GROUP BY rule
""",
}
