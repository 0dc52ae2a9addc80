"""Large buckets are compared in blocks: no link is lost, and no member is a row once for each block."""

import numpy as np
from inkveil.llm import common, paragraphs


def test_a_large_bucket_of_unlike_sets_is_compared_whole(spark, monkeypatch):
    rng, n = np.random.default_rng(5), 300
    sets = []
    for k in range(n):  # many families of two or three, all with one value in common
        own = rng.integers(1, 2**63, 30, dtype=np.uint64) if k % 3 == 0 or k % 7 == 0 else np.append(sets[-1][2:], rng.integers(1, 2**63, 1, dtype=np.uint64))
        sets.append(np.unique(np.append(own, np.uint64(7))))
    made = []
    monkeypatch.setattr(paragraphs, "block_pairs", lambda rows, node: made.append(common.block_pairs(rows, node)) or made[0])
    members = spark.createDataFrame([(1, u, 0, n) for u in range(n)], "h long, u long, hub long, size long")
    label = paragraphs.verified(members, spark.createDataFrame([(u, s.tobytes()) for u, s in enumerate(sets)], "u long, s binary"), 0.8, block=32)
    got = {r["node"]: r["component"] for r in label.collect()}
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert any(root[i] != i for i in range(n)) and {i: got.get(i, i) for i in range(n)} == dict(enumerate(root))
    # ten blocks: with themselves and with each other
    assert made[0].count() == 10 * 11 // 2 and {len(r["l"]) < n for r in made[0].collect()} == {True}


def test_similar_sets_within_and_across_blocks():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    want = {(i, j) for j in range(60) for i in range(j) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.5 * (len(sets[i]) + len(sets[j]) - c)}
    assert set(zip(*map(np.ndarray.tolist, paragraphs.alike(sets, 0.5)))) == want
    assert set(zip(*map(np.ndarray.tolist, paragraphs.alike(sets, 0.5, 25)))) == {(i, j) for i, j in want if i < 25 <= j}
