"""The pipeline's near-copy stage against brute force over all pairs."""

import corpus_pipeline

from inkveil.llm import simhash

from test_operators import prose


def brute(rows):
    """Components of rows (key, text) at a Jaccard similarity of 5-word shingles of 0.8 or more, by all pairs."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {k: shingles(t) for k, t in rows}
    group = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def texts():
    out = [prose(i, 60 + i) for i in range(20)]
    for i in range(20):  # one to six words changed
        w = out[i].split(" ")
        for c in range(1 + i % 6):
            w[(7 + 11 * c) % len(w)] = f"new{c}"
        out.append(" ".join(w))
    common_words = prose(900, 30)
    out += [common_words + " " + prose(901 + i, 30) for i in range(80)]  # share a passage only
    return out + [out[3].upper(), out[3] + " end", "one two", "one  two\t", "one two three", None, "", " \n"]


def test_near_copies(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "_row long, text string")
    want = brute(rows)
    assert {r["row"]: r["component"] for r in simhash.near_copies(df, "_row").collect()} == want
    assert sum(want[i + 20] == i for i in range(20)) >= 4


def test_stage(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert got == set(brute(rows).values())


def test_stage_repeated_and_null_ids(spark):
    rows = [(1, prose(1, 60)), (1, prose(1, 60)), (1, prose(2, 60)), (2, prose(2, 60) + " end"), (None, prose(1, 60)), (None, prose(3, 60)), (None, prose(3, 60)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(1, prose(1, 60)), (1, prose(2, 60)), (None, prose(3, 60)), (None, None)], key=str)
