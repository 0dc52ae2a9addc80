"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkveil.llm import periodic

from test_operators import prose

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every maximal stretch for every period, the smallest period only."""
    n, out, seen = len(w), [], set()
    for p in range(1, n):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            stretch = (i, j + p)
            smallest = next(q for q in range(1, p + 1) if all(w[k] == w[k + q] for k in range(stretch[0], stretch[1] - q)))
            if smallest == p and stretch[1] - stretch[0] >= max(6, 4 * p) and stretch not in seen:
                seen.add(stretch)
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs(monkeypatch):
    rng = random.Random(11)
    for probes in (1 << 20, 50):
        monkeypatch.setattr(periodic, "PROBES", probes)
        for _ in range(400):
            w = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(0, 60))]
            for _ in range(rng.randrange(3)):
                p, k = rng.randrange(1, 8), rng.randrange(3, 7)
                w += ([rng.randrange(4) for _ in range(p)] * k)[: p * k + rng.randrange(3)]
            assert periodic.runs_of(np.array(w, np.int32)) == brute(w), w


def test_long_runs():
    w = np.arange(50_000) % 7
    assert periodic.runs_of(w) == [(0, 50_000, 7)]
    assert periodic.runs_of(np.zeros(100_000, np.int32)) == [(0, 100_000, 1)]
    w = np.concatenate([np.arange(999), np.tile(np.arange(5000, 6000), 5), np.arange(999)])
    assert periodic.runs_of(w) == [(999, 5000, 1000)]


def expected(i, text):
    w = SPLIT.findall(text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    runs = brute(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query(spark, tmp_path):
    rows = [(i, prose(i, 20 + i)) for i in range(120)] + [(None, "a b " * 9), (None, None), (7, None), (8, ""), (9, " \t\r\n"), (10, "x y z " * 5), (10, "x y z " * 5), (11, "\u0000 " * 8), (12, "vi " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "t", "runs", "collapsed", "start", "_best")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    assert sum(r[1] for r in got) >= 10
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0
