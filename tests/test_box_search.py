"""The phrase that stands in a box, and its places, against loops; pages aren't shuffled."""

import random
import re

from pyspark.sql import functions as F

from inkveil.operators import search
from inkveil.plans import entity_queries
from inkveil.plans.catalogue import QUERIES

MARKS = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
BOX = (50, 14, 135, 24)
FIELDS = "doc_id long, page int, idx int, w string, x0 double, y0 double, x1 double, y1 double"


def first(words: list[tuple], box: tuple) -> list[tuple] | None:
    """The first run of a page's words (idx, w, box) in a box that its own box equals."""
    inside, runs = [w for w in words if box[0] <= (w[2] + w[4]) / 2 <= box[2] and box[1] <= (w[3] + w[5]) / 2 <= box[3]], []
    for w in inside:
        if runs and runs[-1][-1][0] == w[0] - 1:
            runs[-1].append(w)
        else:
            runs.append([w])
    near = [r for r in runs if all(abs(f(w[c] for w in r) - v) < 10 for f, c, v in zip((min, min, max, max), (2, 3, 4, 5), box))]
    return near[0] if near else None


def places(pages: dict[int, list[tuple]], box: tuple) -> list[tuple]:
    run = next((r for p in sorted(pages) if (r := first(pages[p], box))), None)
    out = []
    for page, words in pages.items() if run else ():
        if len(run) == 1:
            out += [(page, *w[2:]) for w in words if w[1].strip(MARKS) == run[0][1].strip(MARKS)]
            continue
        text, phrase, ends = " ".join(w[1] for w in words), " ".join(w[1] for w in run), []
        for w in words:
            ends.append((ends[-1] + 1 if ends else 0) + len(w[1]))
        for a in range(len(text) - len(phrase) + 1):
            if text.startswith(phrase, a):
                own = [w for w, e in zip(words, ends) if e >= a and e - len(w[1]) <= a + len(phrase)]
                top, low = min(w[3] for w in own), max(min(w[5], w[3] + 40) for w in own)
                out.append((page, min(w[2] for w in own), top, max(w[4] for w in own), min(low, top + 20) if len({w[3] for w in own}) > 1 else low))
    return out


def cut(text: str | None) -> dict[int, list[tuple]]:
    words = re.findall(r"[^ \t\n\r]+", text or "")
    return {p: [(i, w, 50.0 * (i % 12), 14.0 * (i // 12), 50.0 * (i % 12) + 5 * len(w), 14.0 * (i // 12) + 10) for i, w in enumerate(words[60 * p : 60 * p + 60])] for p in range((len(words) + 59) // 60)}


def test_pages_of_the_search_by_box_are_not_shuffled(spark):
    assert "Exchange" not in QUERIES["search_by_box"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_search_by_box_against_a_loop(spark, tmp_path):
    rng = random.Random(8)
    pool = ["seven77", "sevens7", "a", "(seven77)", "fifteen-letters", "fifteen-letters.", "é😀", "\x0bx", "averyveryverylongword", "seven77a"]
    docs = [(d, rng.choice([" ", "\n\n ", "\t"]).join(rng.choice(pool) for _ in range(rng.choice([0, 13, 30, 59, 60, 61, 200])))) for d in range(150)]
    docs += [(d, t) for d, t in zip(range(200, 206), (None, "", " \n", " " + "a " * 13 + "fifteen-letters" + " (fifteen-letters) " * 90, "ab ab " * 6 + "ab seven77 " * 100, "x " * 60 + "seven77 " * 70))]
    spark.createDataFrame([*docs, (None, "a " * 13 + "fifteen-letters")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((d, *r) for d, t in docs for r in places(cut(t), BOX))
    assert {1, 2} <= {len(r) for _, t in docs for p in cut(t).values() if (r := first(p, BOX))} and len(want) > 200
    assert sorted(map(tuple, QUERIES["search_by_box"](spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, search.like_box(entity_queries.pages(spark, str(tmp_path)), *BOX).collect())) == want


def test_runs_in_a_box_against_a_loop_and_the_query_with_sql(spark):
    rng = random.Random(2)
    rows, pages = [], {}
    for d in range(120):
        for p in rng.sample(range(5), 3):
            at = sorted(rng.sample(range(12), rng.randrange(1, 10)))
            own = pages.setdefault(d, {})[p] = [(i, rng.choice(["ab", "c.", "dd"]), 10.0 * (i % 4), 12.0 * (i // 4), 10.0 * (i % 4) + 8, 12.0 * (i // 4) + rng.choice([10, 50])) for i in at]
            rows += [(d, p, *w) for w in own]
    words = spark.createDataFrame(rows, FIELDS).repartition(5)
    box = (5, 0, 35, 17)
    want = {d: next(((p, r[0][0], len(r), " ".join(w[1] for w in r)) for p in sorted(own) if (r := first(own[p], box))), None) for d, own in pages.items()}
    got = search.phrase_in_box(words, *box).select("doc_id", F.struct("page", "first", "n", "phrase").alias("b")).collect()
    assert {r.doc_id: tuple(r.b) for r in got} == {d: r for d, r in want.items() if r} and len({r.b.n for r in got}) > 1
    assert sorted(map(tuple, search.like_box(words, *box).collect())) == sorted((d, *r) for d, own in pages.items() for r in places(own, box))
