"""URL filters: parts and rules against loops, the model on labels held out."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from inkveil.llm import url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    tail = rest[end:]
    stop = min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def ruled(host, path, rules=url_filter.RULES):
    best = None
    for verdict, text in rules:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = text, verdict
    return best


URLS = [
    None, "", "no url", "http://", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/1?x=1", "https://m.example.com/en/2#t", "https://example.com/en/", "https://example.com/en", "https://notexample.com/en/x", "x://a.net/es/1",
    "https://a.net/fr/1/2/3", "https://net/fr/", "https://a.net/de/?q=/es/", "https://É.org/ü", "http://a.com:80/x", "http://b?x://c.com/d", "http://b.com#/y", "://com/", "http://com", "http://a.org/" + "x/" * 20_000, "http://a.org/a\nb?c\nd",
]


def test_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://a.com/z")] * 2, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS score", "3 AS features", "4 AS _x", "5 AS label", "6 AS top_urls", "7 AS suffix", "8 AS `a.b`")
    got = url_filter.filter_urls(df.drop("a.b"))
    assert set(got.columns) == {"page_id", "url", "features", "_x", "label", "top_urls", "suffix", "host", "path", "rule", "score", "verdict"}
    rows = got.collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r.host, r.path) == parts(r.url)
        known = ruled(r.host, r.path)
        assert r.rule == (known and known[0]) and r.verdict in ("allow", "block") and (not known or r.verdict == known[1])
        assert 0 <= r.score <= 1
    assert {r.rule for r in rows} == {None, *(t for _, t in url_filter.RULES)}
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df.filter("page_id < 3")).collect()} == {"allow"}  # nothing to learn from


def test_entropy(spark):
    texts = ["", "a", "aab", "http://ab.cd/ef?gh=1", "中中é"]
    for t, e in spark.createDataFrame([(t,) for t in texts], "t string").select("t", url_filter.entropy(F.col("t"))).collect():
        assert math.isclose(e, -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0, abs_tol=1e-12)


def test_held_out(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.4
        if bad:
            rows.append((i, f"http://{word(4)}-{word(5)}.{word(6)}{rng.randrange(9999)}.{rng.choice(['biz', 'info'])}/{word(3)}?id={rng.randrange(10**9)}&s={rng.randrange(10**6)}&u={word(6)}", True))
        else:
            rows.append((i, f"https://{word(7)}.{rng.choice(['com', 'org', 'info'])}/{word(6)}/{word(8)}/{rng.randrange(99)}", False))
    df = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, blocked boolean"), rules=())
    learn, rest = df.filter("page_id % 3 <> 1"), df.filter("page_id % 3 = 1")
    model = url_filter.train(learn, df)
    assert model.trees is not None
    out = url_filter.filter_urls(rest, rules=(), model=model)
    right = out.filter((F.col("verdict") == "block") == F.col("blocked")).count()
    assert right / rest.count() > 0.98
    again = url_filter.filter_urls(rest, rules=(), model=url_filter.train(learn, df))
    assert sorted((r.page_id, r.score) for r in out.collect()) == sorted((r.page_id, r.score) for r in again.collect())
