"""Queries around models: spans of tokens to learn from, and answers that are kept by content, with DuckDB's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import memo, patterns, tokens
from inkveil.sources.shared import scratch


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tokens.windowed(tokens.aligned(patterns.detect(docs), tokens.pieces(docs)))


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of all documents as spans of tokens in windows of 384 tokens."""
    return _spans(spark, sf_dir)


def token_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of all tokens that are part of entities."""
    return tokens.tags(_spans(spark, sf_dir))


def _codes(pieces: list[str]) -> list[list[tuple[int, int, str, float]]]:
    return [[(m.start(), m.end(), "CODE", 0.9) for m in re.finditer(r"[0-9]{4}", p)] for p in pieces]


def memoised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents asked after those in English have been: how many entities each has, and whether its answer was there already."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.lit(0).alias("page"), "text", "lang")
    at = scratch(spark, "answers")
    memo.memoised(docs.filter("lang = 'en'"), _codes, at, "codes-1")
    return memo.memoised(docs, _codes, at, "codes-1").select("doc_id", "kept", "error", F.size("answer").alias("n"))


_PIECES = rf"regexp_extract_all(text, '{tokens.TOKEN}|[{tokens.SPACE}]+')"
_TOKEN_SPANS = rf"""WITH pieces AS (SELECT doc_id, unnest(range(len(p))) AS k, unnest(p) AS x FROM (SELECT doc_id, {_PIECES} AS p FROM documents)),
placed AS (SELECT doc_id, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS t_end, sum(CASE WHEN regexp_matches(x, '^[{tokens.SPACE}]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM pieces),
toks AS (SELECT doc_id, i, t_end - length(x) AS t_start, t_end, count(*) OVER (PARTITION BY doc_id) AS n FROM placed WHERE NOT regexp_matches(x, '^[{tokens.SPACE}]')),
ents AS (SELECT DISTINCT doc_id, entity_type, start, "end" AS e_end FROM ({patterns.DETECT_SQL}) d WHERE start < "end"),
firsts AS (SELECT e.*, t.i AS first FROM ents e ASOF JOIN toks t ON e.doc_id = t.doc_id AND e.start < t.t_end),
spans AS (SELECT f.*, t.i AS last, t.n FROM firsts f ASOF JOIN toks t ON f.doc_id = t.doc_id AND f.e_end <= t.t_end WHERE t.t_start < f.e_end),
wins AS (SELECT doc_id, w AS "window", entity_type, greatest(first, w * 334) - w * 334 AS first, last - w * 334 AS last FROM spans, LATERAL (SELECT unnest(CASE WHEN n <= 384 THEN [0] ELSE range(0, ceil(n / 334)::BIGINT) END) AS w) WHERE last BETWEEN w * 334 AND w * 334 + 383)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"token_spans": token_spans, "token_tags": token_tags, "memoised_answers": memoised_answers}
SQL: dict[str, str] = {
    "token_spans": _TOKEN_SPANS + 'SELECT doc_id, "window"::INT AS "window", entity_type, first::INT AS first, last::INT AS last FROM wins',
    "token_tags": _TOKEN_SPANS
    + """, owned AS (SELECT doc_id, "window", token, arg_min(struct_pack(f := first, l := last, t := entity_type), struct_pack(f := first, l := -last, t := entity_type)) AS s FROM (SELECT *, unnest(range(first::BIGINT, last::BIGINT + 1)) AS token FROM wins) GROUP BY ALL)
SELECT doc_id, "window"::INT AS "window", token::INT AS token, (CASE WHEN EXISTS (SELECT 1 FROM owned p WHERE p.doc_id = o.doc_id AND p."window" = o."window" AND p.token = o.token - 1 AND p.s = o.s) THEN 'I-' ELSE 'B-' END) || s.t AS tag FROM owned o""",
    "memoised_answers": "SELECT doc_id, coalesce(text <> '' AND text IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL), false) AS kept, CAST(NULL AS VARCHAR) AS error, coalesce(len(regexp_extract_all(text, '[0-9]{4}')), 0)::INT AS n FROM documents",
}
