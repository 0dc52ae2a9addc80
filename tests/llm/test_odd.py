"""Empty tables, nulls, clashing names and very long texts through every operator; op4, op5, op7 and op10 against brute force."""

import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from inkveil.llm import common, decontamination, packing, paragraphs, quality_crf, quality_rules, simhash, suffixes, token_counts, warc

from test_operators import prose

NAMES = ["u", "t", "h", "k", "g", "w", "l", "id", "fp", "sha", "uid", "at", "row", "own", "n", "length", "start", "score", "c", "x", "piece", "section", "url", "p", "first", "text2", "kind", "removed", "n_words", "_id", "_spans", "_p", "_w", "_bits", "_row", "_words", "_score", "_word", "_held", "_at", "seen"]


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, prose(1, 60)), (4, prose(1, 60)), (None, prose(2, 60)), (5, prose(3, 50_000)), (6, "vi " * 3000), (7, "é\u0000中 \U0001f600 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({n: F.lit(1) for n in NAMES})


def paths():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_odd_rows(spark, tmp_path):
    docs = odd(spark)
    word, byte, pattern = paths()
    n = docs.count()
    bench = spark.createDataFrame([(1, prose(1, 60), 1), (None, "x", 1), (2, None, 1), (3, "", 1)], "item_id long, text string, probe int")
    for df, size in ((docs, n), (docs.limit(0), 0)):
        assert packing.pack(df, word).filter("piece = 0").count() == size
        assert token_counts.count_tokens(df, byte, pattern).filter("section = 0").count() == size
        assert simhash.near_duplicates(df).count() == size
        assert suffixes.repeats(df).count() == size
        assert quality_rules.apply_rules(df.select("doc_id", "text", "score", "h")).count() == size
        model = quality_crf.train(df, spark.createDataFrame([(4, 1), (5, 0)] if size else [], "doc_id long, quality int"))
        assert quality_crf.score(df, model).filter("score between 0 and 1").count() == size
        assert paragraphs.passages(df).filter("removed").filter("doc_id <> 6").count() == 0
        found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
        assert found == ({(4, 1)} if size else set())
        pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"), "sha", "first")
        warc.write_bundles(pages, f"{tmp_path}/w{size}")
        if size:
            out = warc.read_bundles(spark, f"{tmp_path}/w{size}")
            assert out.count() == size and out.filter("record_type = 'revisit'").count() == 1


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd(spark)
    spark.createDataFrame([(1, prose(9, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.decontaminate):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        ids = {r.doc_id for r in out.collect()}
        assert {None, 4, 5, 7} <= ids
        assert out.select(*NAMES).distinct().collect() == [(1,) * len(NAMES)]
    assert corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).filter("doc_id = 4").count() == 1
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))
    assert scored.columns == docs.columns and scored.filter("score <> 1").count() == 0
    assert corpus_pipeline.quality_classifier(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).filter("piece = 0").count() == docs.count()
    assert corpus_pipeline.pack(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_sections(spark, rule):
    """Counts of sections by every rule against a token-by-token count."""
    import tiktoken

    _, byte, pattern = paths()
    texts = ["ab\n\ncd eé中\n", "x" * 50 + "\n" + "  \n  y", "\U0001f600\n\U0001f600", ""]
    encoding, _ = token_counts._encoding(byte, pattern)
    assert isinstance(encoding, tiktoken.Encoding)
    got = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), byte, pattern, rule=rule).collect()}
    want = {}
    for i, text in enumerate(texts):
        stops = [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)]
        bounds = list(zip([0, *stops], [*stops, len(text)]))
        tokens, crossing, at = Counter(), Counter(), 0
        raw = text.encode()
        place = [k for k, c in enumerate(text) for _ in c.encode()]
        for token in encoding.encode_ordinary(text):
            size = len(encoding.decode_single_token_bytes(token))
            a, b = place[at], place[at + size - 1] + 1
            at += size
            held = [max(0, min(b, e) - max(a, s)) for s, e in bounds]
            own = [k for k, x in enumerate(held) if x]
            to = {"start": own[0], "end": own[-1], "most": held.index(max(held))}[rule]
            tokens[to] += 1
            crossing[to] += len(own) > 1
        assert at == len(raw)
        want |= {(i, k): (tokens[k], crossing[k]) for k in range(len(bounds))}
    assert got == want


def test_fingerprints_written_apart(spark):
    texts = [prose(i, 3 * i) for i in range(12)] + ["A b", "a B", "É é", None]
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i] == f"{value:016x}"


def test_bm25_exhaustive(spark):
    """WAND finds what scoring every passage against every item finds."""
    items = [(i, prose(300 + i, 12 + i) + ". " + prose(400 + i, 3) + ".") for i in range(30)]
    docs = [(i, prose(500 + i, 70) + " " + (items[i % 30][1] if i % 3 == 0 else " ".join(items[i % 30][1].split()[: 6 + i % 9])) + " " + prose(700 + i, 90)) for i in range(60)]
    make = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontamination.contaminated(make(docs, "doc_id"), make(items, "item_id"), least=0.3, overlap=0.0).collect()}
    probes = [(i, decontamination.terms_of(t)) for i, t in items]
    tfs = {i: Counter(decontamination.grams(w)) for i, w in probes}
    df = Counter(t for c in tfs.values() for t in c)
    mean = sum(len(w) for _, w in probes) / len(probes)
    want = {}
    for d, text in docs:
        words = decontamination.terms_of(text)
        halves = max(1, -(-len(words) // 64))
        for h in range(max(1, halves - 1)):
            own = set(decontamination.grams(words)[h * 64 : (h + 2) * 64])
            for i, w in probes:
                weight = {t: math.log(1 + (len(probes) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, tf in tfs[i].items()}
                score = sum(x for t, x in weight.items() if t in own) / sum(weight.values())
                if score >= 0.3 - 1e-9:
                    want[d, i] = max(want.get((d, i), 0), round(score, 9))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) >= 20


def test_marginals_by_enumeration():
    rng = np.random.default_rng(5)
    model = quality_crf.Model(rng.normal(size=3 * quality_crf.N_OWN + 3), rng.normal(size=(2, 2)))
    x = rng.random((6, quality_crf.N_OWN))
    unary = quality_crf.with_neighbours(x) @ model.weights
    total, good = 0.0, np.zeros(6)
    for labels in product((0, 1), repeat=6):
        p = math.exp(sum(unary[i] for i in range(6) if labels[i]) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
    assert np.allclose(model.marginals(x), good / total)


def test_counts_of_bits():
    assert len(simhash.covering(6, 4)) == 6 and all(any(set(k) <= set(s) for k in simhash.covering(3, 2)) for s in ((0, 1, 2), (1, 4, 7), (3, 5, 6)))
    assert common.WORD
