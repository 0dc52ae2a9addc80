"""Operator 6: main text of web pages, without the subtrees that a host repeats on many pages."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, probable, table

#: A quote that isn't closed before its tag ends, i.e. before a bracket and not in front of the tag's end or another attribute, is a character like others.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]*\"(?=\s*/?>|\s+[\w:@-]+\s*=)|'[^']*'(?=\s*/?>|\s+[\w:@-]+\s*=)|[\"'])*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed values of HTML: elements without an end tag, whose content is no markup, within a line, and that a <p> can't hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SAME = {"li": {"ul", "ol"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Elements, words of class and id, and roles that are never the article.
NOT_TEXT = frozenset("head nav footer aside form script style noscript template iframe object embed svg canvas audio video button select input textarea dialog menu map".split())
NOT_CLASS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe signup sidebar aside widget nav navbar navigation menu menus"
    " breadcrumb breadcrumbs masthead footer comment comments disqus respond replies share sharing social related recommended recommendations popup modal overlay login pagination pager toolbar".split()
)
#: Words that say no more about an element than where it stands; a class or id of these and at least one of NOT_CLASS is marked.
NEUTRAL = frozenset("site page main top bottom left right upper lower box bar block wrap wrapper container area list link links item items section inner outer post global primary secondary mobile desktop slot unit text content message form button icon icons".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN = ("article", "main")
#: What a list item and so on can end.
ENDED = {t: {t} | ({"td", "th"} if t in ("td", "th", "tr") else {"dt", "dd"} if t in ("dt", "dd") else set()) for t in SAME}
#: Values by which a host's pages are told apart.
FACES = 4


@dataclass
class Node:
    tag: str
    parent: int
    off: bool
    marked: bool  # by a class or id
    article: bool
    main: bool
    parts: list[bytes] = field(default_factory=list)
    hash: int = 0


@dataclass
class Page:
    """Text blocks of a page in order, each with the element it stands in, and those elements' ancestors and subtree hashes."""

    blocks: list[str]
    at: list[int]
    parents: list[int]
    hashes: list[int]
    main: list[bool]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def _marked(names: str) -> bool:
    """Whether a class or id, taken whole, says that an element isn't the article: `cookie-notice` does, `notice-period` doesn't."""
    for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", names).lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if any(p in NOT_CLASS for p in parts) and all(p in NOT_CLASS or p in NEUTRAL for p in parts):
            return True
    return False


def _off(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is no article by what it is, and by its class or id."""
    if tag in NOT_TEXT or tag == "header" and not inside:
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    a = _attributes(attributes)
    names = f"{a.get('class', '')} {a.get('id', '')}"
    off = "hidden" in a or tag not in MAIN and (a.get("role", "").lower() in NOT_ROLE or a.get("aria-hidden", "").lower() == "true")
    return off, _marked(names) or not inside and "header" in names.lower().split()


def parse(source: str) -> Page:
    """Blocks and subtrees of the article: what is in <main>, else in the <article>s if they have most of the text, else in the whole page.

    Menus, forms and the like are left out with everything in them; so are elements marked as adverts and the like by a class
    or id, but for those that hold the <main> or an <article> that is no comment or, on a page without these, most of the text."""
    nodes = [Node("", -1, False, False, False, False)]
    stack = [0]
    open_tags: Counter[str] = Counter()
    blocks: list[tuple[str, int]] = []
    buffer: list[str] = []
    holder = 0

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                blocks.append((text, holder))

    def close(depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            n = nodes[i]
            open_tags[n.tag] -= 1
            if n.tag not in INLINE:
                flush()
            n.hash = xxhash.xxh64_intdigest(b"\0".join([n.tag.encode("utf-8", "replace"), *n.parts]))
            n.parts.clear()
            nodes[n.parent].parts.append(n.hash.to_bytes(8))

    def text(data: str) -> None:
        nonlocal holder
        if data:
            top = nodes[stack[-1]]
            if not top.off:
                if not buffer:
                    holder = stack[-1]
                buffer.append(data)
            if data.strip():
                top.parts.append(" ".join(data.split()).encode("utf-8", "replace"))

    at, end = 0, len(source)
    while at < end:
        m = MARKUP.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags[tag] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        close(depth)
                        break
                    if tag in INLINE and nodes[stack[depth]].tag not in INLINE:
                        break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in SAME:  # a list item ends the one before it, and so on
                if any(open_tags[t] > 0 for t in ENDED[tag]):
                    for depth in range(len(stack) - 1, 0, -1):
                        own = nodes[stack[depth]].tag
                        if own == tag or own in ("td", "th") and tag in ("td", "th", "tr") or own in ("dt", "dd") and tag in ("dt", "dd"):
                            close(depth)
                            if own == tag or tag != "tr":
                                break
                        elif own in SAME[tag]:
                            break
            elif open_tags["p"] > 0:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == "p":
                        close(depth)
                        break
                    if nodes[stack[depth]].tag not in INLINE:
                        break
        if tag in VOID:
            continue
        up = nodes[stack[-1]]
        off, marked = _off(tag, m[3], up.article or up.main)
        if marked and tag in INLINE:  # a part of a line holds no article
            off, marked = True, False
        main = up.main or tag == "main" or 'role="main"' in m[3]
        nodes.append(Node(tag, stack[-1], up.off or off, marked, up.article or tag == "article", main, [m[3].strip().encode("utf-8", "replace")] if m[3].strip() else []))
        stack.append(len(nodes) - 1)
        open_tags[tag] += 1
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            text(source[at : stop.start() if stop else end])
            at = stop.start() if stop else end
    close(1)
    flush()
    chars = [0] * len(nodes)
    holds = [n.tag == "main" or n.tag == "article" and not n.marked for n in nodes]
    for t, i in blocks:
        chars[i] += len(t)
    for i in range(len(nodes) - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
        holds[nodes[i].parent] |= holds[i]
    for n, c, h in zip(nodes[1:], chars[1:], holds[1:]):  # parents come first
        n.off = n.off or nodes[n.parent].off or n.marked and not h and (holds[0] or n.tag == "article" or 2 * c <= chars[0])
    live = [(t, i) for t, i in blocks if not nodes[i].off]
    if any(nodes[i].main for _, i in live):
        live = [(t, i) for t, i in live if nodes[i].main]
    elif 2 * sum(len(t) for t, i in live if nodes[i].article) >= sum(len(t) for t, _ in live):
        live = [(t, i) for t, i in live if nodes[i].article]
    used: set[int] = set()
    for _, i in live:
        while i > 0 and i not in used:
            used.add(i)
            i = nodes[i].parent
    order = sorted(used)
    number = {i: k for k, i in enumerate(order)}
    return Page([t for t, _ in live], [number.get(i, -1) for _, i in live], [number.get(nodes[i].parent, -1) for i in order], [nodes[i].hash for i in order], [nodes[i].article or nodes[i].main for i in order])


def sketch(blocks: list[str]) -> list[int]:
    """FACES values that pages with much the same text share for the most part, each a block's hash, long blocks being likelier."""
    if not blocks:
        return [0] * FACES
    h = np.array([[xxhash.xxh64_intdigest(b.encode("utf-8", "replace"), k) for b in blocks] for k in range(FACES)], np.uint64)
    race = -np.log((h >> np.uint64(11)).astype(float) / 2**53 + 1e-17) / np.array([len(b) for b in blocks])
    return h[np.arange(FACES), race.argmin(1)].view(np.int64).tolist()


def host(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?", "", url or "").split("/")[0].split("?")[0].split("#")[0].lower()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, share: float = 0.01, main_share: float = 0.5) -> DataFrame:
    """Rows (page_id, url, text, n_chars, n_removed), one for each row of `pages`; n_removed: blocks in repeated subtrees.

    A subtree's hash is over its tags, attributes and texts. Those that occur on at least `min_pages` pages of a host, and
    on `share` of its pages (in <article> or <main>: `main_share`), are its template and are deleted. Pages count by what
    tells them apart: copies and near copies of an article count once, for by each of FACES values, blocks drawn by length,
    they are the same page; the value that tells most pages apart counts, so a block that stands on all pages can't hide them.

    Null and empty html gives an empty text. Rows with a null url share a host. Null and repeated ids keep their rows.
    """
    schema = "page_id long, url string, host string, face array<long>, blocks array<string>, at array<int>, parents array<int>, hashes array<long>, main array<boolean>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row_id, url, source in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["h"]):
                p = parse(source or "")
                rows.append((row_id, url, host(url), sketch(p.blocks), p.blocks, p.at, p.parents, np.array(p.hashes, np.uint64).view(np.int64), p.main))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")]).astype({"page_id": "Int64"})

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("h"))
    parsed = cut(src.mapInPandas(run, schema), "parsed")
    flat = parsed.select("host", "face", F.explode(F.arrays_zip("hashes", "main")).alias("s")).select("host", F.col("s.hashes").alias("hash"), F.col("s.main").alias("main"), "face")
    often = cut(flat.groupBy("host", "hash", "main").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).drop("n"), "often")
    faces = probable(flat, "hash", often).join(often, ["host", "hash", "main"]).select("host", "hash", "main", F.posexplode("face").alias("k", "v")).distinct()
    counts = faces.groupBy("host", "hash", "main", "k").agg(F.count("*").alias("n")).groupBy("host", "hash", "main").agg(F.max("n").alias("n")).filter(F.col("n") >= min_pages)
    contents = parsed.select("host", F.posexplode("face").alias("k", "v")).distinct().groupBy("host", "k").agg(F.count("*").alias("n")).groupBy("host").agg(F.max("n").alias("all"))
    least = F.when(F.col("main"), main_share).otherwise(share) * F.col("all")
    templates = cut(counts.join(contents, "host").filter(F.col("n") >= least).groupBy("host").agg(F.collect_set("hash").alias("drop")), "templates")
    # a host's templates are few: each is on a share of its pages; the table of all hosts is broadcast only if it is small
    if templates.agg(F.coalesce(F.sum(F.size("drop") + 8), F.lit(0))).first()[0] <= 1_000_000:
        templates = F.broadcast(templates)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row_id, url, blocks, at, parents, hashes, drop in zip(pdf["page_id"].astype("Int64"), pdf["url"], pdf["blocks"], pdf["at"], pdf["parents"], pdf["hashes"], pdf["drop"]):
                gone: list[bool] = []
                drop = set(drop.tolist()) if drop is not None else ()
                for p, h in zip(parents.tolist(), hashes.tolist()):  # parents come first
                    gone.append(h in drop or p >= 0 and gone[p])
                kept = [b for b, i in zip(blocks, at.tolist()) if i < 0 or not gone[i]]
                text = "\n\n".join(kept)
                rows.append((row_id, url, text, len(text), len(blocks) - len(kept)))
            yield pd.DataFrame(rows, columns=["page_id", "url", "text", "n_chars", "n_removed"]).astype({"page_id": "Int64"})

    out = parsed.select("page_id", "url", "host", "blocks", "at", "parents", "hashes").join(templates, "host", "left")
    return out.drop("host").mapInPandas(clean, "page_id long, url string, text string, n_chars long, n_removed long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).drop("n_removed")


#: For pages as the test tables have them: one <article> of <h1> and <p>, and the five entities below.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
     s AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(h, '<br>', ' ', 'g'), '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', '', 'g'), chr(1)) AS b FROM a),
     e AS (SELECT page_id, url, list_transform(b, lambda x: replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&')) AS b FROM s),
     t AS (SELECT page_id, url, list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS b FROM e)
SELECT page_id, url, coalesce(array_to_string(b, chr(10) || chr(10)), '') AS text, length(coalesce(array_to_string(b, chr(10) || chr(10)), ''))::BIGINT AS n_chars FROM t
"""
