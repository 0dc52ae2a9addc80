"""Substring dedup where texts have long periodic stretches, against a count of all strings."""

import hashlib
import random
from collections import Counter

from inkveil.llm import suffixes

from test_operators import prose


def test_stretches(spark):
    rng = random.Random(9)
    units = ["ab", "onhe. Is ", "x", "the of ", prose(3, 12)[:70] + " ", prose(4, 30)[:140]]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            u = rng.choice(units)
            k = rng.randrange(len(u))
            parts += [prose(rng.randrange(4), 40)[: rng.randrange(0, 300)], ((u * 800)[k:])[: rng.choice([150, 380, 401, 410, 500, 700, 1500])], prose(900 + i, rng.randrange(30))]
        rows.append((i, "".join(parts)))
    raws = [(i, t.encode()) for i, t in rows]
    seen = Counter(r[p : p + 400] for _, r in raws for p in range(len(r) - 399))
    want = set()
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - 399):
            if seen[r[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.add((i, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    raw = b"onhe. Is " * 4000
    assert len(suffixes.seeds(raw)[0]) <= 3 and suffixes.seeds(raw)[3].tolist() == [[0, len(raw)]]
