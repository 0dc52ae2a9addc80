"""Slots for models: texts in groups of sentences, spans shifted to the text, and prompts. The model itself is given."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators import entities

#: Least score of a model's entity, and most characters of a text that it gets at once.
LEAST, MOST = 0.4, 800
SENTENCE = re.compile(r"\S(?:.*?(?:[.!?](?=\s)|$))", re.S)


def groups(text: str, most: int = MOST) -> list[tuple[int, str]]:
    """Pieces of a text with their places: a paragraph's sentences, as many as fit; a longer sentence is divided at spaces."""
    out: list[tuple[int, str]] = []
    for line in re.finditer(r"[^\n]+", text):
        first = last = None
        for s in SENTENCE.finditer(line[0]):
            a, b = line.start() + s.start(), line.start() + s.end()
            if first is not None and b - first > most:
                out.append((first, text[first:last]))
                first = None
            while b - a > most:
                end = text.rfind(" ", a + 1, a + most + 1)
                end = end if end > a else a + most
                out.append((a, text[a:end]))
                a = end + (text[end : end + 1] == " ")
            if a < b:
                first, last = a if first is None else first, b
        if first is not None:
            out.append((first, text[first:last]))
    return out


def recognise(docs: DataFrame, model: Callable[[list[str]], list[list[tuple[int, int, str, float]]]], least: float = LEAST, most: int = MOST) -> DataFrame:
    """Entities (doc_id, page, entity_type, start, end, score, original_text) that `model` finds: it takes pieces of texts and
    gives (start, end, type, score) of each. Scores under `least` and pronouns go; of equal type and span the best stays."""
    schema = "doc_id long, page int, entity_type string, start int, end int, score double, original_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, page, text in zip(pdf["doc_id"], pdf["page"], pdf["text"]):
                own = groups(text or "", most)
                for (at, piece), found in zip(own, model([p for _, p in own]) if own else []):
                    rows += [(doc, page, kind, at + a, at + b, score, piece[a:b]) for a, b, kind, score in found if score >= least]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "entity_type", "start", "end", "score", "original_text"])

    found = entities.without_pronouns(docs.select("doc_id", "page", "text").mapInPandas(run, schema))
    return found.groupBy("doc_id", "page", "entity_type", "start", "end", "original_text").agg(F.max("score").alias("score"))


def prompt(template: str, **parts: Column) -> Column:
    """A template with the columns in place of {name}."""
    out: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 and piece not in parts:
            raise KeyError(piece)
        out.append(F.coalesce(parts[piece], F.lit("")) if i % 2 else F.lit(piece))
    return F.concat(*out)
