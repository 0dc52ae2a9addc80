"""Containment by rare grams against all pairs."""

import random

from inkveil.operators import labels


def _rows(rng, n, longest):
    return [(rng.choice(["f", "g", None]), "".join(rng.choice("abé😀?") for _ in range(rng.randrange(longest))) if rng.random() < 0.95 else None, rng.choice(["P", "Q"])) for _ in range(n)]


def test_matches_against_all_pairs(spark):
    rng = random.Random(11)
    found, labelled = _rows(rng, 300, 9), _rows(rng, 60, 14)
    found += [("hot", "abc" * 5 + str(i), "P") for i in range(200)] + [("hot", "?", "P"), ("hot", "", "Q")]
    labelled += [("hot", "ABCABC", "P"), ("hot", "c7", "Q"), ("hot", "😀", "P")]
    schema = "file string, text string, type string"
    f, m = spark.createDataFrame(found, schema), spark.createDataFrame(labelled, schema)
    for typed in (False, True):
        fits = lambda a, b: a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and (not typed or a[2] == b[2]) and (a[1].lower() in b[1].lower() or b[1].lower() in a[1].lower())
        want = {(*a, any(fits(a, b) for b in labelled)) for a in found}
        got = [tuple(r) for r in labels.partial(f, m, typed).collect()]
        assert set(got) == want and len(got) == len(want)
    assert labels.partial(f.limit(0), m).count() == 0 and not any(r.matched for r in labels.partial(f, m.limit(0)).collect())


def test_names_against_all_pairs(spark):
    rng = random.Random(5)
    names = [("".join(rng.choice("ab1") for _ in range(rng.randrange(1, 8))) + ".pdf",) for _ in range(80)]
    targets = [("d/" + "".join(rng.choice("ab1") for _ in range(rng.randrange(1, 8))) + ".json",) for _ in range(40)]
    got = {r.name: r.target for r in labels.mapped_names(spark.createDataFrame(names, "name string"), spark.createDataFrame(targets, "target string"), least=0.3).collect()}
    base = lambda x: x.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for (name,) in names:
        a, equal, near = base(name), [t for (t,) in targets if base(t) == base(name)], []
        for (t,) in targets:
            if base(t) in a or a in base(t):
                s = len(set(min(a, base(t), key=len))) / max(len(a), len(base(t)))
                near += [(s, t)] if s > 0.3 else []
        assert got[name] == (min(equal) if equal else max(near)[1] if near else None)


def test_small_sides_leave_the_other_unshuffled_by_grams(spark):
    """A needle's grams aren't sorted or shuffled when what they are looked up in is small: the rows shuffled are needles, not grams."""
    needles = spark.range(2000).selectExpr("'k' AS f", "concat('some words of a longer line, number ', id, ' of them, that nothing holds') AS _n")
    texts = spark.createDataFrame([("k", "xx " + "some words of a longer line, number 77 of them, that nothing holds" + " yy"), ("k", "other")], "f string, _t string")
    out = labels._held_pairs(needles, texts, ["f"])
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString() and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["_n"] for r in out.collect()] == ["some words of a longer line, number 77 of them, that nothing holds"]


def test_greedy_over_many_copies(spark):
    """Similarities are taken of distinct texts and the fold is linear, so thousands of labels of one file and type take seconds."""
    import time

    found = spark.range(6000).selectExpr("'f' AS file", "id AS pos", "concat('label ', id % 3) AS text", "'T' AS type")
    known = spark.range(4000).selectExpr("'f' AS file", "id AS pos", "upper(concat('label ', id % 2)) AS text", "'T' AS type")
    began = time.monotonic()
    got = {(r.found_text, r.label_text): r["count"] for r in labels.greedy(found, known, 0.9).groupBy("found_text", "label_text").count().collect()}
    assert got == {("label 0", "LABEL 0"): 2000, ("label 1", "LABEL 1"): 2000}
    assert time.monotonic() - began < 30
