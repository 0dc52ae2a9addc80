"""Operator 8: quality rules as a short-circuit cascade, with DataFrame functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows, at most, on which the rules' cost and selectivity are estimated.
SAMPLE_ROWS = 2000
#: Copies of the sample over which a rule is timed.
REPEATS = 8


@dataclass(frozen=True)
class Rule:
    """`rejects` is SQL over `text` and the base columns, true for rows to reject, never null."""

    name: str
    rejects: str


RULES = (
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "3 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * length(regexp_replace(text, '[^\\\\p{Lu}]', '')) > word_chars"),
    Rule("exclamations", "3 * length(regexp_replace(text, '[^!]', '')) > n_words"),
    Rule("digits", "4 * length(regexp_replace(text, '[^0-9]', '')) > word_chars"),
)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word) appended.

    Columns of those names that `docs` has are replaced. A null or empty text counts zero everywhere.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(_without(x, SPACE)) > 0)
    words = F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)

    def windows(w: Column) -> Column:
        # 3-word windows as (two hashes, place), sorted so that equal ones are neighbours; equal hashes, of 96 bits together, count as equal words
        size = F.greatest(F.size(w) - 2, F.lit(0))
        zipped = F.arrays_zip(F.slice(w, 1, size).alias("a"), F.slice(w, 2, size).alias("b"), F.slice(w, 3, size).alias("c"))
        return F.array_sort(F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), F.hash(x["c"], x["b"], x["a"]).alias("g"), i.alias("i"))))

    def again(s: Column) -> Column:
        # places of windows that equal a neighbour
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))

        pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: F.when(same(x, y), F.array(x["i"], y["i"])))
        return F.flatten(F.filter(pairs, lambda p: p.isNotNull()))

    covered = F.array_distinct(F.flatten(F.transform(F.col("_again"), lambda i: F.array(i, i + 1, i + 2))))
    out = docs.withColumns({"_words": words, "_lines": lines})
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_sorted": windows(F.col("_words")), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_words", "_lines")
    out = out.withColumn("_again", again(F.col("_sorted"))).drop("_sorted")
    return out.withColumns({"n_repeat_words": F.size(covered).cast("long"), "word_chars": F.length(_without(t, SPACE)).cast("long"), "n_symbols": (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long")}).drop("_again")


def order_rules(texts: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """`rules` by rejections per second on a random sample of about `sample_rows` rows of `texts`, best first. The order never changes a verdict.

    Each rule is timed over REPEATS copies of the sample, less the time of a rule that does nothing, so that it isn't the start of a job that is measured."""
    total = texts.count()
    few = texts if total <= sample_rows else texts.sample(sample_rows / total, seed=8)
    sample = cut(measures(cut(few, "sample")), "rules")
    copies = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(rejects: str) -> tuple[int, float]:
        began = time.perf_counter()
        return copies.agg(F.count_if(F.expr(rejects))).first()[0], time.perf_counter() - began

    run("false")
    nothing = run("false")[1]
    rates = [n / max(0.001, s - nothing) for n, s in (run(r.rejects) for r in rules)]
    return [r for _, r in sorted(zip(rates, rules), key=lambda x: -x[0])]


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with its measures, base_failed, kept and failed_rule (the first rule that rejected; null if kept).

    The rules stand in one CASE, so a row that one rejects is not put to the later ones. Null texts have no words: base_failed.
    """
    src = docs.withColumn("text", F.coalesce(F.col(text_col), F.lit("")))
    order = order_rules(src.select("text"), rules, sample_rows)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for r in order:
        failed = failed.when(F.expr(r.rejects), F.lit(r.name))
    return measures(src).withColumn("base_failed", base).withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM d LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words OR 3 * n_dup_lines > n_lines
            OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
            OR 3 * length(regexp_replace(text, '[^!]', '', 'g')) > n_words
            OR 4 * length(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars) AS kept
FROM b
"""
