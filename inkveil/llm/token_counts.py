"""Operator 4: token counts per section by offset-mapped attribution."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = ("start", "end", "most")
_made: dict[tuple[str, str], tuple] = {}


def _encoding(path: str, pattern: str):
    """The encoding of a rank file and the byte length of each of its tokens, once per worker."""
    import tiktoken

    if (path, pattern) not in _made:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        _made[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _made[path, pattern]


def token_spans(text: str, encoding, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) character of each token of `text`, which is encoded once.

    A token that holds part of a character's bytes spans that character."""
    ids = np.asarray(encoding.encode_to_numpy(text, disallowed_special=()), np.int64)
    ends = np.cumsum(size[ids])
    starts = ends - size[ids]
    if not text.isascii():
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        return char[starts], char[ends - 1] + 1
    return starts, ends


def sections_of(text: str) -> np.ndarray:
    """Starts of the sections of a text: lines, each with the line feed that ends it. An empty text is one section."""
    starts = [0]
    at = text.find("\n") + 1
    while at and at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return np.array(starts, np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, length: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens allotted to each section, and of those the ones that cross into another section.

    Interval join of sorted spans: each token finds the sections of its first and last character. A token over several
    sections goes to that of its first character ("start"), of its last ("end"), or to the one that holds most of its
    characters, the earlier on a tie ("most")."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    to = last if rule == "end" else first.copy()
    crossing = first != last
    if rule == "most":
        stops = np.append(sections[1:], length)
        for i in np.nonzero(crossing)[0]:
            s = np.arange(first[i], last[i] + 1)
            to[i] = s[np.argmax(np.minimum(stops[s], ends[i]) - np.maximum(sections[s], starts[i]))]
    n = len(sections)
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most") -> DataFrame:
    """Rows (doc_id, section, start, length, n_tokens, n_crossing), one for each section of each row of `docs`.

    A text is encoded once, whole, so the counts of its sections sum to its tokens. `start` and `length` are in characters.
    Null and empty texts give one section without tokens. Null and repeated ids keep their rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, size = _encoding(path, pattern)
        for pdf in batches:
            parts = []
            for text in pdf["t"]:
                text = text or ""
                sections = sections_of(text)
                tokens, crossing = attribute(*token_spans(text, encoding, size), sections, len(text), rule) if text else (np.zeros(1, np.int64),) * 2
                parts.append((np.arange(len(sections), dtype=np.int32), sections, np.diff(np.append(sections, len(text))), tokens, crossing))
            if parts:
                ids = pdf["id"].astype("Int64").repeat([len(x[0]) for x in parts]).reset_index(drop=True)
                yield pd.DataFrame({"doc_id": ids} | {c: np.concatenate(x) for c, x in zip(["section", "start", "length", "n_tokens", "n_crossing"], zip(*parts))})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "doc_id long, section int, start long, length long, n_tokens long, n_crossing long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
