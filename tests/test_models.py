"""Spans of tokens against a loop over tokens and windows; kept answers against counted calls."""

import random
import re
import tempfile
from collections import Counter

from pyspark.sql import functions as F

from inkveil.operators import memo, tokens

DOCS, SPANS = "doc_id long, text string", "doc_id long, entity_type string, start int, end int"


def by_loop(text, spans, most, overlap):
    toks = [m.span() for m in re.finditer(r"\w+|[^\w\s]", text or "")]
    out = set()
    for w, s in enumerate([0] if len(toks) <= most else range(0, len(toks), most - overlap)):
        for a, b, kind in spans:
            own = range(s, min(s + most, len(toks)))
            first = next((i for i in own if toks[i][1] > a), None)
            last = next((i for i in own if toks[i][0] < b <= toks[i][1]), None)
            if first is not None and last is not None:
                out.add((w, kind, first - s, last - s))
    return out


def test_token_spans_against_a_loop(spark):
    rng = random.Random(7)
    docs, spans = [(100, None), (101, ""), (102, " \n"), (103, "x" * 50_000), (104, "é, ñ😀b")], [(100, "A", 0, 3), (101, "A", 0, 1), (102, "A", 0, 1), (103, "A", 5, 50_000), (104, "A", 0, 6), (104, "B", 4, 99), (999, "A", 0, 1), (103, "B", 9, 9), (103, None, 1, 2), (103, "A", None, 4)]
    for d in range(40):
        text = "".join(rng.choice(["ab", "c", " ", "  ", ".", "\n", "é", "1-"]) for _ in range(rng.choice([3, 10, 12, 60])))
        docs.append((d, text))
        spans += [(d, rng.choice("PQ"), *sorted((rng.randrange(len(text) + 2), rng.randrange(len(text) + 2)))) for _ in range(6)]
    spans += spans[:60]
    toks = tokens.tokens(spark.createDataFrame(docs, DOCS).withColumn("n", F.lit("clash")).withColumn("p", F.lit(1)))
    got = tokens.windowed(tokens.aligned(spark.createDataFrame(spans, SPANS).withColumn("span", F.lit(0)), toks), 10, 3)
    of = lambda d: [(a, b, k) for e, k, a, b in spans if e == d and a is not None and a < b]
    want = {(d, *r) for d, text in docs for r in by_loop(text, of(d), 10, 3)}
    rows = [tuple(r) for r in got.select("doc_id", "window", "entity_type", "first", "last").collect()]
    # spans with unlike characters may have the same tokens, so rows can repeat
    assert set(rows) == want and len(want) > 100
    tagged = {(r.doc_id, r.window, r.token): r.tag for r in tokens.tags(got).collect()}
    expected = {}
    for d, w, kind, a, b in sorted(want, key=lambda r: (r[0], r[1], r[3], -r[4], r[2] or "")):
        for t in range(a, b + 1):
            expected.setdefault((d, w, t), (a, b, kind))
    assert tagged == {(d, w, t): ("I-" if expected.get((d, w, t - 1)) == s else "B-") + (s[2] or "UNKNOWN") for (d, w, t), s in expected.items()}
    assert tokens.aligned(spark.createDataFrame([], SPANS), toks).count() == 0 == tokens.tokens(spark.createDataFrame([], DOCS)).count()


def test_each_text_is_asked_once(spark):
    at, log = tempfile.mkdtemp() + "/answers", tempfile.mkdtemp() + "/calls"

    def model(pieces):
        with open(log, "a") as f:
            f.write("".join(pieces) + "\n")
        if any("bad" in p for p in pieces):
            raise ValueError("no answer")
        return [[(m.start(), m.end(), "N", 0.9) for m in re.finditer(r"[0-9]+", p)] + [(0, 1, "LOW", 0.1)] for p in pieces]

    calls = lambda: Counter(open(log).read().split("\n")[:-1])
    rows = [(1, 0, "a 12"), (2, 0, "a 12"), (2, 1, "bad 1"), (3, 0, None), (4, 0, ""), (None, None, "c"), (5, 0, " "), (5, 0, " ")] + [(i, 0, "hot 7") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, page int, text string").withColumn("key", F.lit("clash")).repartition(5)
    ask = lambda df, version="v1", m=model: memo.memoised(df, m, at, version, attempts=3, pause=0.01)
    first = {(r.doc_id, r.page): r for r in ask(docs).collect()}
    assert calls() == {"a 12": 1, "bad 1": 3, "c": 1, "hot 7": 1} and ask(docs).count() == len(rows)
    assert [(x.start, x.end, x.entity_type, x.original_text) for x in first[2, 0].answer] == [(2, 4, "N", "12")] and not any(r.kept for r in first.values())
    assert first[2, 1].error == "ValueError: no answer" and first[2, 1].answer == [] == first[3, 0].answer and first[3, 0].error is None
    second = {(r.doc_id, r.page): r for r in ask(docs, m=lambda pieces: [[(0, 3, "LATER", 1.0)] for _ in pieces]).collect()}
    assert calls()["a 12"] == 1 and second[1, 0].kept and second[1, 0].answer == first[1, 0].answer and second[250, 0].kept
    assert not second[2, 1].kept and second[2, 1].error is None and second[2, 1].answer[0].entity_type == "LATER"
    assert not any(r.kept for r in ask(docs, "v2").collect()) and calls()["hot 7"] == 2
    assert memo.entities(ask(docs)).filter("entity_type = 'N'").count() == 202
    assert ask(docs.limit(0)).count() == 0
