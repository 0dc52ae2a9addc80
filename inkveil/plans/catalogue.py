"""All queries of the library outside llm, and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import boxes, numbering, patterns, relational, text
from inkveil.plans import access_queries, entity_queries, model_queries, record_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split()


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = set(re.findall(r"\{([a-z]\w+)\}", text))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # quantifiers of expressions have braces too, so tables are named here and not by the formatter
        views = {t: f"inkveil_{t}_{uuid.uuid4().hex}" for t in names}
        for t, view in views.items():
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(view)
        out = spark.sql(re.sub(r"\{([a-z]\w+)\}", lambda m: f"{views[m[1]]} AS {m[1]}", text))
        for view in views.values():
            spark.catalog.dropTempView(view)
        return out

    return query


for _name, _text in (relational.STATEMENTS | text.STATEMENTS | boxes.STATEMENTS).items():
    _spark, _duck = _text if isinstance(_text, tuple) else (_text, _text)
    QUERIES[_name] = _run(_spark)
    SQL[_name] = re.sub(r"\{([a-z]\w+)\}", r"\1", _duck)


def detect_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def detect_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entities with equal type and span, the one with the highest score."""
    e = detect_entities(spark, sf_dir)
    return e.groupBy("doc_id", "entity_type", "start", "end").agg(F.max("score").alias("score"))


def detect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities at or over the default threshold by type, each span counted once."""
    e = detect_dedup(spark, sf_dir).filter(F.coalesce("score", F.lit(0.0)) >= 0.85)
    return e.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


QUERIES |= {"detect_entities": detect_entities, "detect_dedup": detect_dedup, "detect_summary": detect_summary}
_DEDUP = f'SELECT doc_id, entity_type, start, "end", max(score) AS score FROM ({patterns.DETECT_SQL}) GROUP BY ALL'
SQL |= {"detect_entities": patterns.DETECT_SQL, "detect_dedup": _DEDUP, "detect_summary": f"SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_DEDUP}) WHERE coalesce(score, 0) >= 0.85 GROUP BY 1"}


def entity_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that each entity touches; entities' offsets count in the text of words joined by single spaces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)), " ").alias("text"))
    found = patterns.detect(docs).select("doc_id", "pattern", "start", "end")
    return boxes.touched(docs, found).select("doc_id", "pattern", "start", "end", "idx", "w")


QUERIES["entity_words"] = entity_words
SQL["entity_words"] = (
    r"WITH documents AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \t\n\r]+'), ' ') AS text FROM main.documents), "
    "words AS (SELECT doc_id, idx, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS w_end FROM (SELECT doc_id, unnest(range(len(m)))::INT AS idx, unnest(m) AS w FROM (SELECT doc_id, string_split(text, ' ') AS m FROM documents WHERE text <> ''))) "
    f'SELECT e.doc_id, e.pattern, e.start, e."end", idx, w FROM ({patterns.DETECT_SQL}) e JOIN words ON words.doc_id = e.doc_id AND w_end >= e.start AND w_end - length(w) <= e."end"'
)


def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in seven contiguous chunks of equal size (the last may be smaller)."""
    rows = numbering.numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    return rows.select("doc_id", F.floor((F.col("rn") - 1) / F.ceil(F.col("total") / 7)).cast("int").alias("chunk"))


def verification_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document."""
    rows = numbering.numbered(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")
    return rows.filter("rn % 10 = 0").select("doc_id")


QUERIES |= {"chunk_split": chunk_split, "verification_sample": verification_sample}
SQL |= {
    "chunk_split": "SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil((SELECT count(*) FROM documents) / 7.0)) AS INT) AS chunk FROM documents",
    "verification_sample": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) t WHERE rn % 10 = 0",
}


def detect_looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with look-around (persons, phones), for which DuckDB has no expressions; tests hold them against the expressions themselves."""
    return patterns.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), patterns.LOOKING)


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all 28 patterns by document and type: how many, and the first and last place. Its parts are detect_entities, which has SQL, and detect_looking."""
    found = patterns.detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), patterns.PATTERNS)
    return found.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.max("end").alias("last"), F.max("score").alias("score"))


QUERIES |= {"detect_all": detect_all, "detect_looking": detect_looking} | entity_queries.QUERIES | record_queries.QUERIES | stream_queries.QUERIES | model_queries.QUERIES | access_queries.QUERIES
SQL |= entity_queries.SQL | record_queries.SQL | stream_queries.SQL | model_queries.SQL | access_queries.SQL
