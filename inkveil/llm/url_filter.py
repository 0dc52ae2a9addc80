"""Operator 12: URL filters by rules, and by gradient-boosted trees on lexical features where no rule fits. DataFrame operations only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host and path). A rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs, about, that the trees are fitted on: those with the least hashes.
SAMPLE_URLS = 20_000
TREES, DEPTH, STEP, SEED = 20, 4, 0.3, 12
#: Labelled URLs that a suffix's share of blocked ones is drawn to the share of all by.
SMOOTHING = 20

FEATURES = ("url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_marks", "longest_segment", "top_urls", "top_blocked", "site_urls", "site_blocked")


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What stands behind the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or of null."""
    return F.translate(F.regexp_extract(_behind(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What stands behind the host up to `?`, `#` or the end; empty without `://` or of null."""
    return F.regexp_extract(_behind(url), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal lengths the first in order of code points), and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last one wraps the others, so it is asked first
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """`pages` with host, path, rule and rule_verdict; columns of these names are replaced."""
    url = F.col(url_col)
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "rule_verdict": verdict})


def entropy(text: Column) -> Column:
    """Bits a character of a text's own character counts, over its sorted characters; 0 of an empty one."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weight = lambda n: n * F.log2(n.cast("double"))

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["n"] + 1).otherwise(1).alias("n"), F.when(same, a["s"]).otherwise(a["s"] + weight(a["n"])).alias("s"))

    start = F.struct(F.lit("").alias("c"), F.lit(1).alias("n"), F.lit(0.0).alias("s"))
    return F.aggregate(chars, start, step, lambda a: F.when(F.size(chars) > 0, F.log2(F.size(chars).cast("double")) - (a["s"] + weight(a["n"])) / F.size(chars)).otherwise(0.0))


def _labels_of(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL alone, doubles; a null URL is empty."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    length = F.length(u)
    own = {
        "url_length": length, "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query), "host_depth": count(host, "."), "path_depth": count(path, "/"),
        "digit_ratio": F.when(length > 0, count(u, string.digits) / length).otherwise(0.0), "entropy": entropy(u), "n_params": F.when(query == "", 0).otherwise(count(query, "&;") + 1), "n_marks": count(u, "-_%~@"),
        "longest_segment": F.array_max(F.transform(F.split(path, "/"), F.length)),
    }
    return {k: v.cast("double") for k, v in own.items()}


@dataclass
class UrlModel:
    """Statistics of suffixes (suffix, urls, blocked), written, and the trees; without trees every URL gets `share`, the blocked share of the labelled ones."""

    suffixes: DataFrame
    share: float
    trees: GBTClassificationModel | None

    def features(self, pages: DataFrame, url_col: str) -> DataFrame:
        """`pages`, which has host and path, as (_in: the row, features by name)."""
        rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("_in"))
        host = F.col("_in.host")
        rows = rows.withColumns(lexical(F.col("_in")[url_col], host, F.col("_in.path")) | {"_top": _labels_of(host, 1), "_site": _labels_of(host, 2)})
        for name in ("top", "site"):
            stats = self.suffixes.select(F.col("suffix").alias(f"_{name}"), F.log2(F.col("urls") + 1.0).alias(f"{name}_urls"), F.col("share").alias(f"{name}_blocked"))
            rows = rows.join(stats, f"_{name}", "left")
        return rows.fillna({"top_urls": 0.0, "site_urls": 0.0, "top_blocked": self.share, "site_blocked": self.share}).select("_in", *FEATURES)

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows of features() with `score`, from 0 to 1: how likely the URL is one to block."""
        if self.trees is None:
            return rows.withColumn("score", F.lit(self.share))
        return self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(rows)).withColumn("score", vector_to_array("probability")[1])


def train(labelled: DataFrame, every: DataFrame, url_col: str = "url", sample_urls: int = SAMPLE_URLS) -> UrlModel:
    """A model from `labelled` (url, host, path, blocked boolean) and the suffix counts of `every` (host).

    Suffixes are the host's last label and its last two; their counts are over all rows. The trees are fitted on distinct labelled URLs, about
    `sample_urls` of them, chosen by a hash of the URL, so that the same rows give the same model. Without labels, or with one kind of label, there are no trees."""
    both = lambda h: F.explode(F.array_distinct(F.array(_labels_of(h, 1), _labels_of(h, 2)))).alias("suffix")
    n, n_blocked = labelled.agg(F.count("*"), F.count_if("blocked")).first()
    share = n_blocked / n if n else 0.0
    counts = every.select(both(F.col("host"))).groupBy("suffix").agg(F.count("*").alias("urls"))
    by = labelled.select(both(F.col("host")), "blocked").groupBy("suffix").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"))
    smooth = (F.coalesce("b", F.lit(0)) + SMOOTHING * share) / (F.coalesce("n", F.lit(0)) + SMOOTHING)
    model = UrlModel(cut(counts.join(by, "suffix", "left").select("suffix", "urls", smooth.alias("share")), "suffixes"), share, None)
    if 0 < n_blocked < n:
        some = F.pmod(F.xxhash64(url_col), F.lit(1 << 30)) <= F.lit(int((1 << 30) * min(1, sample_urls / n)))
        few = labelled.filter(some).select(F.col(url_col), "host", "path", "blocked").dropDuplicates([url_col])
        sample = cut(model.features(few, url_col).select(F.col("_in.blocked").cast("double").alias("label"), *FEATURES).coalesce(1).sortWithinPartitions("label", *FEATURES), "urls")
        kinds = sample.agg(F.countDistinct("label")).first()[0]
        if kinds == 2:
            trees = GBTClassifier(labelCol="label", featuresCol="_x", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED)
            model.trees = trees.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(sample))
    return model


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, sample_urls: int = SAMPLE_URLS, model: UrlModel | None = None) -> DataFrame:
    """The rows of `pages` with host, path, rule, score and verdict (allow or block); columns of these names are replaced.

    A URL that a rule fits gets the verdict of the longest one; these are also the labelled URLs that the model learns from. Others are blocked
    from a score of 0.5 on. A null URL, or one without `://`, has an empty host and path and no rule. Repeated rows stay. An empty table gives none."""
    rows = judged(pages, url_col, rules)
    if model is None:
        known = rows.filter("rule is not null").select(F.col(url_col), "host", "path", (F.col("rule_verdict") == "block").alias("blocked"))
        model = train(known, rows.select("host"), url_col, sample_urls)
    scored = model.score(model.features(rows, url_col))
    verdict = F.coalesce("_in.rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict", "score", "verdict")]
    return scored.select(*(F.col("_in")[c].alias(c) for c in rest), *(F.col(f"_in.{c}").alias(c) for c in ("host", "path", "rule")), "score", verdict.alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
