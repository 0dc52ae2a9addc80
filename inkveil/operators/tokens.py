"""Entities as spans of tokens, in overlapping windows of tokens, with a tag for each token that they cover.

Ids of documents are taken to be unique; offsets count characters from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = r" \t\n\x0B\f\r"
WORD = r"\p{L}\p{M}\p{N}_"
#: Tokens: words, and every other character that is no white space.
TOKEN = f"[{WORD}]+|[^{WORD}{SPACE}]"
MOST, OVERLAP = 384, 50


def pieces(docs: DataFrame, expression: str = TOKEN) -> DataFrame:
    """Rows (doc_id, pieces): the lengths of each text's tokens, in order, and less than 0 those of the white space between. Null and blank texts have no tokens.

    What lies between tokens must be white space: one expression cuts a text into tokens and gaps, whose lengths add up to the offsets."""
    size = lambda x: F.when(x.rlike(f"^[{SPACE}]"), -F.length(x)).otherwise(F.length(x))
    return docs.select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(f"{expression}|[{SPACE}]+"), F.lit(0)), size).alias("pieces"))


def tokens(docs: DataFrame, expression: str = TOKEN) -> DataFrame:
    """Rows (doc_id, i, t_start, t_end, n): the tokens of each text and how many it has, placed where the text is, without a shuffle."""

    @F.pandas_udf("array<int>")
    def ends(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda p: None if p is None else np.cumsum(np.abs(p))[p > 0])

    own = pieces(docs, expression).select("doc_id", F.filter("pieces", lambda x: x > 0).alias("size"), ends("pieces").alias("t_end"))
    rows = own.select("doc_id", F.size("size").alias("n"), F.posexplode(F.arrays_zip("size", "t_end")).alias("i", "z"))
    return rows.select("doc_id", "i", (F.col("z.t_end") - F.col("z.size")).alias("t_start"), "z.t_end", "n")


def aligned(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Distinct rows (doc_id, entity_type, start, end, first, last, n): the first token that ends behind an entity's start, and the
    one that reaches its end. Entities that are empty, or end behind the last token or in a gap, go.

    `tokens` are rows of tokens or of `pieces`, which aren't taken apart: a document's entities come to it and are found by bisection."""
    if "pieces" not in tokens.columns:
        gap = lambda s, x, i: x["t_start"] - F.coalesce(F.get(s, i - 1)["t_end"], F.lit(0))
        sizes = lambda s: F.flatten(F.transform(s, lambda x, i: F.array(-gap(s, x, i), x["t_end"] - x["t_start"])))
        own = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "t_start", "t_end"))).alias("s"))
        tokens = own.select("doc_id", F.transform(F.array("s"), sizes)[0].alias("pieces"))

    @F.pandas_udf("first array<int>, last array<int>")
    def places(pieces: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for p, a, b in zip(pieces, starts, ends):
            end = np.cumsum(np.abs(p))[p > 0]
            last = np.searchsorted(end, b)
            out.append((np.searchsorted(end, a, "right"), np.where(np.searchsorted(end - p[p > 0], b) > last, last, -1)))
        return pd.DataFrame(out, columns=["first", "last"])

    spans = entities.filter("start < end").groupBy("doc_id").agg(F.collect_set(F.struct("entity_type", "start", "end")).alias("spans"))
    both = tokens.filter("pieces is not null").join(spans, "doc_id").select("doc_id", "spans", F.size(F.filter("pieces", lambda x: x > 0)).alias("n"), places("pieces", F.transform("spans", lambda x: x["start"]), F.transform("spans", lambda x: x["end"])).alias("at"))
    rows = both.select("doc_id", "n", F.explode(F.arrays_zip("spans", F.col("at.first").alias("first"), F.col("at.last").alias("last"))).alias("z"))
    return rows.filter("z.last >= 0").select("doc_id", "z.spans.entity_type", "z.spans.start", "z.spans.end", "z.first", "z.last", "n")


def windowed(spans: DataFrame, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, window, entity_type, first, last): spans in windows of `most` tokens, counted from the window's first token.

    A text of at most `most` tokens is one window; a longer one has a window at every `most - overlap` tokens. A span is in each
    window that holds its last token; what lies before the window is cut off. Windows without spans have no rows."""
    step = most - overlap
    lowest = F.greatest(F.lit(0), F.ceil((F.col("last") - most + 1) / step).cast("int"))
    k = F.when(F.col("n") <= most, F.array(F.lit(0))).otherwise(F.sequence(lowest, F.floor(F.col("last") / step).cast("int")))
    at = F.col("window") * step
    rows = spans.withColumn("window", F.explode(k))
    return rows.select("doc_id", "window", "entity_type", (F.greatest("first", at) - at).cast("int").alias("first"), (F.col("last") - at).cast("int").alias("last"))


def tags(spans: DataFrame) -> DataFrame:
    """Rows (doc_id, window, token, tag): B- and the type at the first token that a span has, I- at its others; other tokens have no rows.

    A token that several spans cover belongs to the one that starts first, then the longest, then the least type. A window's tokens
    are few, so the order inside it is one small group."""
    key = ["doc_id", "window", "token"]
    own = spans.select("doc_id", "window", F.explode(F.sequence("first", "last")).alias("token"), F.struct("first", (-F.col("last")).alias("_l"), "entity_type").alias("s"))
    best = own.groupBy(*key).agg(F.min("s").alias("s"))
    order = Window.partitionBy("doc_id", "window").orderBy("token")
    inner = (F.lag("token").over(order) == F.col("token") - 1) & (F.lag("s").over(order) == F.col("s"))
    return best.select(*key, F.concat(F.when(inner, "I-").otherwise("B-"), F.coalesce("s.entity_type", F.lit("UNKNOWN"))).alias("tag"))
