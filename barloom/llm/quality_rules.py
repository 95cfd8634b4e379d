"""Line-first quality rules, all in Spark's own functions.

A text is split into lines and each line judged by itself. A line fails when

* punctuation: it has words, and either no sentence end at all or a share of signs (#*$%&<>) above the limit,
* navigation: its bars part more than a tenth of its words,
* boilerplate: it holds a phrase of page furniture (cookies, subscriptions, scripts, filler text).

Failing lines are removed. A document is kept if it passes the base rules and has lost no more than the allowed share
of its characters. Everything is worked out inside a row: no shuffle, no join, no Python.

Defined cases: a NULL or wordless text has zero counts and fails the base rules (fewer than ten words); a NULL doc_id is
kept; repeated rows are judged one by one; an empty table gives an empty result; columns other than doc_id and text are
not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD_PATTERN

SPACES = r"[\x20\x09-\x0D]+"
SIGNS = r"[^#*$%&|<>]+"
NOISE = r"[^#*$%&<>]+"
SENTENCE_END = "[.!?…。][\"')\\]»”’]*([\\x20\\x09-\\x0D]|$)"
PHRASES = (
    "accept cookies|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|"
    "javascript is disabled|lorem ipsum|click here|subscribe to our|sign up for our|share this|skip to content"
)
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
NOISE_PERCENT = 5
BAR_PERCENT = 10
LOST_PERCENT = 30


def repeated_words(hashes: Column, ordered: Column) -> Column:
    """Words in windows found twice or more: the union of the repeated windows' positions.

    `ordered` holds (hash, position) sorted, or NULL where all hashes differ.
    """
    same = lambda a, b: F.coalesce(a.h == b.h, F.lit(False))
    twice = F.transform(
        ordered,
        lambda x, i: F.when(same(F.get(ordered, i - 1), x) | same(F.get(ordered, i + 1), x), x.p),
    )
    return F.array_sort(F.filter(twice, lambda p: p.isNotNull()))


def line_fails(line: Column) -> Column:
    words = F.size(F.split(F.trim(line), SPACES))
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    noise = F.length(F.regexp_replace(line, NOISE, ""))
    return (
        ~line.rlike(SENTENCE_END)
        | (noise * 100 > F.length(line) * NOISE_PERCENT)
        | (bars * 100 > words * BAR_PERCENT)
        | F.lower(line).rlike(PHRASES)
    )


def judge(docs: DataFrame, lost_percent: int = LOST_PERCENT) -> DataFrame:
    """doc_id, the base counts and verdicts, n_lines, n_failed_lines, lost_share and clean_text (passing lines)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    words = F.col("words")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
    )
    rows = rows.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, windows))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_PATTERN)))
    rows = rows.select(
        "doc_id",
        "n_words",
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SIGNS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("hashes") > F.size(F.array_distinct("hashes")),
            F.array_sort(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ).alias("ordered"),
        "lines",
        F.filter("lines", line_fails).alias("failed"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("passed"),
    )
    rows = rows.withColumn("twice", repeated_words(F.col("ordered"), F.col("ordered")))
    covered = F.aggregate(
        F.transform("twice", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("twice", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda total, x: total + F.length(x))
    rows = rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("failed").cast("long").alias("n_failed_lines"),
        chars("lines").alias("chars"),
        chars("failed").alias("lost_chars"),
        F.array_join("passed", "\n").alias("clean_text"),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    lost = F.col("lost_chars") * 100 > F.col("chars") * lost_percent
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & ~lost).alias("kept"),
        "n_lines",
        "n_failed_lines",
        "lost_chars",
        "clean_text",
    )


def sql(documents: str = "documents") -> str:
    """The same rows (without clean_text) for DuckDB; repeated windows are found by comparing their words."""
    spaces, end = SPACES, SENTENCE_END
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT *, regexp_extract_all(text, '{WORD_PATTERN}') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5),
win AS (SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g FROM pos),
rep AS (SELECT rid, p FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d),
real AS (SELECT rid, x FROM lines WHERE regexp_matches(x, '{WORD_PATTERN}')),
judged AS (
  SELECT rid, x, NOT regexp_matches(x, '{end.replace("'", "''")}')
    OR length(regexp_replace(x, '{NOISE}', '', 'g')) * 100 > length(x) * {NOISE_PERCENT}
    OR (length(x) - length(replace(x, '|', ''))) * 100
       > len(string_split_regex(trim(x, ' '), '{spaces}')) * {BAR_PERCENT}
    OR regexp_matches(lower(x), '{PHRASES}') AS bad
  FROM real),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, sum(length(x)) AS chars,
  count(*) FILTER (WHERE bad) AS n_failed_lines, coalesce(sum(length(x)) FILTER (WHERE bad), 0) AS lost_chars
  FROM judged GROUP BY rid),
t AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{spaces}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '{SIGNS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
    CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars, coalesce(chars, 0) AS chars
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT lost_chars * 100 > chars * {LOST_PERCENT} AS kept, n_lines, n_failed_lines, lost_chars
FROM b
"""
