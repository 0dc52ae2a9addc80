"""A page's words in one row: offsets, items and boxes against loops, and what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import entities
from inkveil.plans.catalogue import QUERIES

DIR = "/root/testdata/sf0.001"


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("name", ["page_texts", "phrase_places", "engine_tags"])
def test_pages_are_not_shuffled(spark, name):
    assert shuffles(QUERIES[name](spark, DIR)) == 0


def test_boxes_against_a_loop(spark):
    rng = random.Random(5)
    rows, spans = [], []
    for page in range(40):
        at, words = 0, []
        for i in range(rng.randrange(0, 30)):
            w = rng.choice(["é", "ab", "😀x", "word", " ", " ab "])
            words.append((7, page, i, w, float(20 * (i % 4)), float(15 * (i // 4)), float(20 * (i % 4) + 9), float(15 * (i // 4) + rng.choice([5, 50]))))
        rows += words
        text = sum(len(w[3].strip()) + 1 for w in words if w[3].strip())
        for k in range(6):
            a = rng.randrange(-2, text + 3)
            spans += [(7, page, a, a + rng.randrange(0, 20), "T" if k else None)] * rng.choice([1, 2])
    want = set()
    for doc, page, a, b, kind in spans:
        at, touched = 0, []
        for r in (r for r in rows if r[1] == page and r[3].strip()):
            end = at + len(r[3].strip())
            if end >= a and at <= b:
                touched.append(r)
            at = end + 1
        if touched:
            y1 = max(min(r[7], r[5] + 40) for r in touched)
            y1 = min(y1, min(r[5] for r in touched) + 20) if len({r[5] for r in touched}) > 1 else y1
            want.add((doc, page, a, b, kind, min(r[4] for r in touched), min(r[5] for r in touched), max(r[6] for r in touched), y1))
    words = spark.createDataFrame(rows, "doc_id long, page int, idx int, w string, x0 double, y0 double, x1 double, y1 double").repartition(3)
    own = spark.createDataFrame(spans, "doc_id long, page int, start int, end int, kind string")
    assert len(want) > 100
    for w in (words, entities.paged(words)):
        got = [tuple(r) for r in entities.placed(own, w).collect()]
        assert len(got) == len(want) and set(got) == want
        places = {(r.page, r.idx): (r.w_start, r.w_end) for r in entities.word_offsets(w).collect()}
        texts = {r.page: r.text for r in entities.page_text(w).collect()}
        assert all(texts[r[1]][slice(*places[r[1], r[2]])] == r[3].strip() for r in rows if r[3].strip())


def test_left_parts_of_an_entity_are_placed_from_its_start_on(spark):
    words = spark.createDataFrame([(1, 0, i, w, float(i), 0.0, i + 0.5, 1.0) for i, w in enumerate("a the b a c a".split())], "doc_id long, page int, idx int, w string, x0 double, y0 double, x1 double, y1 double")
    found = spark.createDataFrame([(1, 0, "X", 3, 0.9, "the a"), (1, 0, "X", 4, 0.9, "a the"), (1, 0, "X", 99, 0.9, "a"), (1, 0, "X", None, 0.9, "a")], "doc_id long, page int, entity_type string, start int, score double, original_text string")
    got = entities.after_removal(found, words, ["the"]).select("original_text", "start", "end", F.col("x0").cast("int")).collect()
    assert [tuple(r) for r in got] == [("a", 8, 9, 3)]
