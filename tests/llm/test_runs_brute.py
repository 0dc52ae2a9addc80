"""Repeated runs of over 50 words against brute force over all pairs of places."""

import random

from inkveil.llm import paragraphs

from test_operators import prose


def covered(rows, least):
    """Words (id, place) in runs of `least` words that occur before, by id and place."""
    first, out = {}, set()
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - least + 1):
            run = tuple(w[k : k + least])
            if run in first:
                out.update((i, x) for x in range(k, k + least))
            else:
                first[run] = i, k
    return out


def test_runs(spark):
    rng, pool = random.Random(7), [prose(100 + i, 51 + 13 * i) for i in range(8)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + 10 * i, rng.randrange(1, 60))]
        for j in range(rng.randrange(1, 4)):
            p = rng.choice(pool).split(" ")
            a = rng.randrange(0, max(1, len(p) - 60))
            parts += [" ".join(p[a:]) if rng.random() < 0.4 else " ".join(p), prose(1001 + 10 * i + j, rng.randrange(1, 30))]
        words = " ".join(parts).split(" ")
        rows.append((i, "".join(w + ("\n" if rng.random() < 0.07 else " ") for w in words)))
    rows += [(70, rows[3][1]), (71, rows[3][1].upper() + " more"), (72, "a b c " * 60), (73, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = set()
    text = dict(rows)
    for r in paragraphs.passages(df, min_words=10_000).filter("removed").collect():
        raw = text[r["doc_id"]].encode()
        a = len(raw[: r["start"]].split())
        n = len(raw[r["start"] : r["start"] + r["length"]].split())
        assert n == r["n_words"]
        gone.update((r["doc_id"], x) for x in range(a, a + n))
    want, loose = covered(rows, 51), covered(rows, 12)
    assert gone <= loose | {(72, x) for x in range(180)}
    lost = {x for x in want - gone if x[0] != 72}
    assert len(lost) <= 0.01 * len(want), (len(lost), len(want))
