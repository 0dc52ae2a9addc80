"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkveil.llm import decontamination, html_text, packing, paragraphs, quality_crf, quality_rules, simhash, suffixes, token_counts, warc

WORDS = [f"{a}{b}" for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "r s t n l".split()]


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + WORDS[(x >> 43) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="module")
def docs(spark):
    passage = prose(500, 90)
    rows = [(i, prose(i, 80 + i)) for i in range(20)]
    rows += [(20, rows[3][1]), (21, rows[3][1] + " end"), (22, prose(600, 40) + " " + passage + " " + prose(601, 40)), (23, prose(602, 30) + "\n" + passage), (24, None), (25, ""), (26, " \n\t "), (27, prose(700, 6000)), (27, prose(700, 6000)), (None, prose(701, 60)), (28, "été ñandú 日本 " * 30), (29, "vi " * 400)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("score"), F.lit(1).alias("h"), F.lit(2).alias("start"), F.lit(3).alias("n_words"))


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_simhash(docs):
    got = simhash.near_duplicates(docs).collect()
    prints = {(r["doc_id"], int(r["fingerprint"], 16)) for r in got}
    assert prints == {(i, simhash.fingerprint(t)) for i, t in plain(docs)}
    by = {}
    for i, f in prints:
        reach, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, g in prints:
                if g not in reach and (x ^ g).bit_count() <= 2:
                    reach.add(g)
                    todo.append(g)
        by[i] = min((j for j, g in prints if g in reach and j is not None), default=None)
    assert {r["doc_id"]: r["component_id"] for r in got} == by
    assert len(got) == docs.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (24, 25, 26)} == {24}


def test_simhash_long_list():
    import numpy as np

    values = np.array([0x1234 + (i << 20) for i in range(600)], np.uint64)
    links = list(simhash.forest(values, 2))
    assert len(links) <= 599 and all(int(values[i] ^ values[j]).bit_count() <= 2 for i, j in links)


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path).collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in plain(docs):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            x = ids[k : k + 2048]
            want[i, k // 2048, k, len(x), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in x))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in rows.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("merge", [20_000, 60, 7])
def test_suffixes(docs, merge, monkeypatch):
    monkeypatch.setattr(suffixes, "MERGE", merge)
    shared = [prose(800 + i, 90) for i in range(3)]
    more = [(100 + i, prose(900 + i, 40 + i) + " " + shared[i % 3][: 300 + 20 * (i % 14)] + " " + prose(950 + i, 50)) for i in range(60)]
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.repeats(docs).collect()}
    raws = [(i, (t or "").encode()) for i, t in plain(docs)]
    seen = Counter(r[p : p + 400] for _, r in raws for p in range(len(r) - 399))
    want = set()
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - 399):
            if seen[r[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.add((i, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    assert got == want


def test_token_ids():
    """Ids of odd strings are those of the tokenizer itself."""
    import random

    import public_tokenizers

    own, rng = packing.WordTokenizer.of(public_tokenizers.path("word_bpe_49k.json")), random.Random(3)
    assert own.known
    pool = [chr(i) for i in range(0x180)] + list("\u0301\u4e2d\u0429\u2003\u3000\u200b\u1e9e\u0130\u03a3\u0558")
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_merge_compares_no_known_prefix():
    runs = [sorted(f"{'a' * (i % 7)}{i * j % 97}".encode() for i in range(50)) for j in (3, 5, 7)]
    coded = [suffixes.decode(rest, s.tolist(), n.tolist()) for rest, s, n in map(suffixes.front_code, runs)]
    out = list(suffixes.merge(coded))
    assert [k for *_, k in out] == sorted(sum(runs, []))
    assert all(s == suffixes.common_prefix(a[2], k) for a, (s, _, k) in zip(out, out[1:]))


def test_paragraphs(docs):
    spans = paragraphs.passages(docs)
    got = {(r["doc_id"], r["removed"]) for r in spans.collect()}
    assert {22, 23, 20, 3, 21} <= {i for i, _ in got} and not any(i in {i for i, _ in got} for i in (0, 1, 2, 4, 5, 24, 25, 26))
    kept = {r["doc_id"]: r["text"] for r in paragraphs.remove(docs, spans.filter("removed")).collect()}
    assert kept[22] == dict(plain(docs))[22] and len(kept[23]) < len(dict(plain(docs))[23]) and len(kept[20]) < 0.5 * len(dict(plain(docs))[20])


def test_paragraphs_clusters(spark):
    """Clusters against brute force over all pairs, in buckets that hold several components and more than a block."""
    base = prose(1, 40).split(" ")
    rows = [(i, " ".join(base[:k] + [f"own{i}"] + base[k:])) for i, k in enumerate((0, 5, 20, 39, 40))]
    rows += [(10 + i, " ".join(base[:9]) + " " + prose(50 + i, 30)) for i in range(6)]
    rows += [(20 + i, rows[6][1] + f"\nline {i}") for i in range(4)] + [(30, rows[7][1] + " tail"), (31, "short line")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraphs.passages(df, min_run=1).collect()
    cut = {}
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            w = line.lower().split()
            if len(w) >= 8:
                cut[i, at] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
            at += len(line.encode()) + 1
    group = {k: k for k in cut}
    for a in cut:
        for b in cut:
            if a < b and len(cut[a] & cut[b]) >= 0.8 * len(cut[a] | cut[b]) - 1e-9 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    size = Counter(group.values())
    assert {((r["doc_id"], r["start"]), (r["cluster_doc_id"], r["cluster_start"])) for r in got} == {(k, g) for k, g in group.items() if size[g] > 1}
    assert all(r["removed"] == ((r["doc_id"], r["start"]) != (r["cluster_doc_id"], r["cluster_start"])) for r in got)
    empty = paragraphs.passages(df.limit(0))
    assert empty.count() == 0 and paragraphs.remove(df, empty).count() == len(rows)


def test_decontamination(spark, docs):
    items = [(1, prose(500, 90)), (2, prose(900, 40)), (3, "What is it? " + prose(3, 83).split(" ", 5)[5]), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert {(22, 1), (23, 1)} <= got and not any(j in (2, 4, 5) for _, j in got)
    assert got == {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench, shard_postings=50).collect()}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_token_counts(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in plain(docs):
        want[i] += len(t.encode(text or "").ids)
    assert {r["doc_id"]: r["n"] for r in got} == dict(want)


def test_html(spark):
    menu = "<div><span>Home</span> <span>Shop</span></div>"
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", f"<body>{menu}<div><p>Text {i} &amp; more<p>and {i}</div><div class='comments'>c</div><footer>f</footer>") for i in range(8)] + [(8, None, None), (9, "http://a.com/9", ""), (10, "http://b.com", "<nav>x</nav><article><header><h1>T</h1></header><p>a\n b<br>c</p></article>rest")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages).collect()}
    assert got[3] == "Text 3 & more\n\nand 3" and got[8] == "" and got[9] == "" and got[10] == "T\n\na b c"


def test_html_marks():
    """What the class and id of an element say, and what stays although they seem to."""
    of = lambda h: "|".join(html_text.parse(h).blocks)
    assert of("<div class='social-history'>a</div><p>b b b") == "a|b b b"
    assert of("<article><p>long text<section id='notice-period'>x</section><div class='ad-slot'>no</div></article>") == "long text|x"
    assert of("<div class='layout has-sidebar'><article>t</article></div>") == "t"
    assert of("<div class='cookie-notice'>c c</div><div><p>the body</div>") == "the body"
    assert of("<div class='sidebar'><p>most of all of the text</div><p>b") == "most of all of the text|b"
    assert of("<main><h1>T</h1><p>intro</p><article>body</article></main><article>card</article>") == "T|intro|body"
    assert of("<div>the text of the page is here</div><article>card</article>") == "the text of the page is here|card"
    assert of("<p class=\"x>Hello</p><a title='a > b' href=x>hi</a>") == "Hello|hi"
    assert of("<b>" * 50 + "<p>x" * 50) == "|".join("x" * 50)


def test_html_templates(spark):
    """Only recurrence tells these blocks: one on 5% of a large host's pages, one longer than all articles, and none of copies."""
    rows = []
    for i in range(400):
        article = "".join(f"<p>{prose(3000 + 7 * i + k, 12 + k)}</p>" for k in range(3))
        note = f"<div>{prose(1, 120)}</div>"
        promo = f"<div>{prose(2, 15)}</div>" if i % 20 == 0 else ""
        rows.append((i, f"http://h.com/{i}", f"<body>{note}<div>{article}</div>{promo}"))
    rows += [(1000 + i, f"http://h.com/copy{i}", f"<body><div><p>{prose(9, 40)}</p><p>{prose(10, 50)}</p></div><i>{i}</i>") for i in range(30)]
    rows += [(2000, None, f"<p>{prose(11, 90_000)}"), (2001, "", None), (2002, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("h")).withColumn("hashes", F.lit(2))
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert all(got[i] == "\n\n".join(prose(3000 + 7 * i + k, 12 + k) for k in range(3)) for i in range(400))
    assert all(got[1000 + i] == f"{prose(9, 40)}\n\n{prose(10, 50)}\n\n{i}" for i in range(30))
    assert got[2000] == prose(11, 90_000) and got[2001] == "" and got[2002] == "" and len(got) == len(rows)
    assert html_text.main_text(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/3", None), (4, None, ""), (5, "http://a/5", "é" * 100), (None, "u", "same"), (1, "http://a/1", "same")]
    path = f"file://{tmp_path}/w"
    warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    back = warc.read_bundles(spark, path).collect()
    assert Counter((r["row_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back) == Counter([(1, "response", None, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 200), (None, "response", None, 4), (1, "response", None, 4)])
    for r in back:
        with open(r["bundle"].removeprefix("file:").replace("///", "/"), "rb") as f:
            data = f.read()
        fields, _ = warc.read_record(data, r["frame"], r["frame_offset"])
        assert fields.get("X-Row-Id") == (None if r["row_id"] is None else str(r["row_id"]))
        assert (fields.get("X-Row-Id", ""), r["frame"], r["frame_offset"]) in warc.record_index(data)


def test_rules_and_crf(spark, docs):
    rules = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert rules[24]["n_words"] == 0 and not rules[24]["kept"] and rules[0]["kept"] and rules[29]["n_repeat_words"] == 400 and rules[29]["base_failed"]
    good = [(i, prose(i, 60) + ".\n" + prose(i + 1, 30) + ".", 1) for i in range(60)]
    bad = [(i, prose(i, 20) + ".\n" + "### ".join(prose(i, 60).split()), 0) for i in range(60, 90)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality_crf.train(rows.select("doc_id", "text"), rows.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")))
    out = quality_crf.score(rows, model).select("quality", "score").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in out) >= 88
    assert 0 <= model.score(None) == model.score("") <= 1
