"""Labels of people and of engines: reading, cleaning, flattening, matching and their figures.

Labels are rows (file, text, type); where an order counts, `pos` has it."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.chunking import similarity
from inkveil.sources.shared import scratch


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(text: Column | str) -> Column:
    """A text with written line feeds and all white space as single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\\n"), F.lit(" ")), r"\s+", " "))


def _object(text: str) -> str | None:
    """`text` as compact JSON if it is an object."""
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return json.dumps(found, ensure_ascii=False, separators=(",", ":")) if isinstance(found, dict) else None


def _repair(line: str | None) -> str | None:
    line = re.sub(r",(\s*[}\]])", r"\1", line or "")
    out, at = _object(line), len(line)
    while out is None and (at := line.rfind("}", 0, at)) >= 0:
        out = _object(line[: at + 1])
    return out


def repaired(lines: DataFrame, column: str) -> DataFrame:
    """JSON lines as compact objects in `repaired`: trailing commas go, then what follows each closing brace, from the right, until it parses; `bad` tells those that never do."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(_repair)

    return lines.withColumn("repaired", of(column)).withColumn("bad", F.col("repaired").isNull())


def _answer(text: str | None) -> str | None:
    text = text or ""
    for start in (m.start() for m in re.finditer(r"\{", text)):
        depth = 0
        for i in range(start, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                if found := _object(text[start : i + 1]):
                    return found
                break
    return None


def answer(text: Column | str) -> Column:
    """The first balanced JSON object in a model's answer, compact; fences and words around it don't matter."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(_answer)

    return of(_col(text))


def manual(text: Column | str) -> Column:
    """(type, text) of a manual label: a JSON map of lists, else pairs in its broken form, else [TYPE: text], else <TYPE>text</TYPE>."""
    t = _col(text)
    pair = "array<struct<type:string,text:string>>"
    parsed = F.from_json(t, "map<string,array<string>>")
    whole = F.flatten(F.transform(F.map_entries(parsed), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("type"), v.alias("text")))))

    def found(rx: str) -> Column:
        a, b = F.regexp_extract_all(t, F.lit(rx), F.lit(1)), F.regexp_extract_all(t, F.lit(rx), F.lit(2))
        return F.zip_with(a, b, lambda x, y: F.struct(x.alias("type"), F.trim(y).alias("text")))

    forms = [found(rx) for rx in (r'"(\w+)"\s*:\s*\[?\s*"([^"]*)"', r"\[([A-Za-z_]+):\s*([^\]]+)\]", r"<([A-Za-z_]+)>([^<]*)</\1>")]
    out = F.coalesce(whole, F.array().cast(pair))
    for f in forms:
        out = F.when(F.size(out) > 0, out).otherwise(f)
    return out


def flat(results: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rows (file, page, text, type, confidence) of nested results (file, pages of (page, entities)); types mapped, missing confidence 1."""
    rows = results.select("file", F.explode("pages").alias("p")).select("file", F.col("p.page").alias("page"), F.explode("p.entities").alias("e")).select("file", "page", "e.text", "e.type", F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))
    return rows.replace(mapping, subset=["type"]) if mapping else rows


#: Characters of a gram. Texts of at most so many are looked up whole.
GRAM = 3


#: Bits of a gram's hash; the bits above hold how many texts have it, at most RARE.
BITS, RARE = 40, (1 << 22) - 1


def _grams(text: str, size: int) -> Column:
    """The distinct runs of `size` characters, by one expression that goes over the text once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?=(\P{{Cs}}{{{size}}}))"), F.lit(1)))


def _by_gram(df: DataFrame) -> DataFrame:
    """A row for each of `_all`, distinct grams, with its hash `_g`. Grams only find candidates, so equal hashes of different ones do no harm. (The outer form keeps Spark from taking the grams once more in a filter.)"""
    rows = df.withColumn("_g", F.explode_outer("_all")).filter("_g is not null").drop("_all")
    return rows.withColumn("_g", F.xxhash64("_g").bitwiseAND((1 << BITS) - 1))


def _written(df: DataFrame) -> DataFrame:
    """`df` as a table whose size is known when the next join is planned, so that a small one is sent to all tasks and the other side isn't shuffled."""
    at = scratch(df.sparkSession, "labels")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _held_pairs(needles: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, _n, _t): needles `_n` of more than `GRAM` characters and the texts `_t` that hold them.

    A needle is looked up by that of its grams which the fewest texts of its key have, so a pair is made where a text shares the
    needle's rarest gram; a needle with a gram that no text has is dropped. Needles and texts go by digests until they are candidates."""
    grams = _by_gram(texts.select(*key, F.md5("_t").alias("_id"), _grams("_t", GRAM).alias("_all")))
    counts = _written(grams.groupBy(*key, "_g").agg(F.count("*").alias("_c")))
    own = needles.filter(F.length("_n") > GRAM).select(*key, F.md5("_n").alias("_nid"), _grams("_n", GRAM).alias("_all")).withColumn("_size", F.size("_all"))
    place = F.shiftleft(F.least("_c", F.lit(RARE)), BITS) + F.col("_g")
    rare = _by_gram(own).join(counts, [*key, "_g"]).groupBy(*key, "_nid", "_size").agg(F.count("*").alias("_hits"), F.min(place).alias("_p"))
    rare = _written(rare.filter("_hits = _size").select(*key, "_nid", F.col("_p").bitwiseAND((1 << BITS) - 1).alias("_g")))
    near = _written(grams.join(rare, [*key, "_g"]).select(*key, "_nid", "_id"))
    whole = near.join(needles.withColumn("_nid", F.md5("_n")), [*key, "_nid"]).join(texts.withColumn("_id", F.md5("_t")), [*key, "_id"])
    return whole.filter(F.contains("_t", F.col("_n"))).select(*key, "_n", "_t")


def _short(texts: DataFrame, key: list[str], *kept: str | Column) -> DataFrame:
    """The runs of 1 to `GRAM` characters of texts, as `_n`."""
    return texts.select(*key, *kept, F.explode(F.concat(*(_grams("_t", k) for k in range(1, GRAM + 1)))).alias("_n"))


def held(needles: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """The distinct needles (key, _n) that some text (key, _t) of equal key holds. An empty needle is held by any text; nulls hold and match nothing."""
    needles, texts = needles.select(*key, "_n").distinct(), texts.select(*key, "_t").filter("_t is not null").distinct()
    short = needles.filter(F.length("_n").between(1, GRAM)).join(_short(texts, key).distinct(), [*key, "_n"], "left_semi")
    empty = needles.filter("_n = ''").join(texts, key, "left_semi")
    return short.unionByName(empty).unionByName(_held_pairs(needles, texts, key).select(*key, "_n").distinct())


def holders(needles: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """The distinct texts (key, _t) that hold some needle (key, _n) of equal key."""
    needles, texts = needles.select(*key, "_n").distinct(), texts.select(*key, "_t").filter("_t is not null").distinct()
    brief = _written(needles.filter(F.length("_n").between(1, GRAM)))
    out = texts.join(needles.filter("_n = ''"), key, "left_semi").unionByName(_held_pairs(needles, texts, key).select(*key, "_t"))
    if not brief.isEmpty():  # else the texts needn't be read for it
        ids = _written(_short(texts, key, F.md5("_t").alias("_id")).join(brief, [*key, "_n"], "left_semi").select(*key, "_id").distinct())
        out = out.unionByName(texts.withColumn("_id", F.md5("_t")).join(ids, [*key, "_id"], "left_semi").select(*key, "_t"))
    return out.distinct()


def partial(found: DataFrame, labelled: DataFrame, typed: bool = False) -> DataFrame:
    """Distinct found labels with `matched`: whether a label of the file holds its text or is held by it, without case, and, if `typed`, has its type.

    Texts meet by rare grams, not all with all of a file."""
    key = ["file", "type"] if typed else ["file"]
    own, other = found.select(*key, F.lower("text").alias("_n")), labelled.select(*key, F.lower("text").alias("_n"))
    as_text = lambda df: df.withColumnRenamed("_n", "_t")
    hits = held(own, as_text(other), key).unionByName(holders(other, as_text(own), key).withColumnRenamed("_t", "_n")).distinct()
    rows = found.select("file", "text", "type").distinct().withColumn("_n", F.lower("text"))
    return rows.join(hits.withColumn("matched", F.lit(True)), [*key, "_n"], "left").select("file", "text", "type", F.coalesce("matched", F.lit(False)).alias("matched"))


def greedy(found: DataFrame, labelled: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows (file, found_text, label_text, type): each found label, in order, takes its file's first label of its type with a similarity over `least` that is still free.

    Similarities are of distinct texts only. Which label is free hangs on all found before, so one task takes a file's labels of a type as a
    stream of sorted rows: it holds the numbers of those that are free, by text, and the texts that fit."""
    group = ["file", "type"]
    f, m = found.select(*group, "pos", "text").dropna(subset=group), labelled.select(*group, "pos", "text").dropna(subset=group)
    texts = f.select(*group, F.col("text").alias("_f")).distinct().join(m.select(*group, F.col("text").alias("_m")).distinct(), group)
    fits = texts.filter(similarity("_f", "_m") > least)
    rows = m.select(*group, F.lit(0).alias("step"), F.col("pos").alias("_pm"), F.lit(None).alias("_pf"), "text", F.lit(None).cast("string").alias("other"))
    rows = rows.unionByName(fits.select(*group, F.lit(1).alias("step"), F.lit(None).alias("_pm"), F.lit(None).alias("_pf"), F.col("_f").alias("text"), F.col("_m").alias("other")))
    rows = rows.unionByName(f.select(*group, F.lit(2).alias("step"), F.lit(None).alias("_pm"), F.col("pos").alias("_pf"), "text", F.lit(None).cast("string").alias("other")))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, fitting, n = None, {}, {}, 0
        for pdf in batches:
            out = []
            for file, kind, step, text, other in zip(pdf["file"], pdf["type"], pdf["step"], pdf["text"], pdf["other"]):
                if (file, kind) != now:
                    now, free, fitting = (file, kind), {}, {}
                if step == 0:
                    n += 1
                    free.setdefault(text, deque()).append(n)
                elif step == 1:
                    fitting.setdefault(text, []).append(other)
                elif left := [(free[t][0], t) for t in fitting.get(text, ()) if free[t]]:
                    label = min(left)[1]
                    free[label].popleft()
                    out.append((file, text, label, kind))
            yield pd.DataFrame(out, columns=["file", "found_text", "label_text", "type"])

    kinds = {c: found.schema[c].dataType.simpleString() for c in group}
    rows = rows.repartition(*group).sortWithinPartitions(*group, "step", "_pm", "_pf", "text").select(*group, "step", "text", "other")
    return rows.mapInPandas(take, f"file {kinds['file']}, found_text string, label_text string, type {kinds['type']}")


def figures(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 by group, of rows with an outcome; 0 where a denominator is."""
    n = outcomes.groupBy(*by).agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return n.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def compared(a: DataFrame, b: DataFrame, by: str = "type") -> DataFrame:
    """Counts by type of two tables, their difference and ratio (infinite where the second is 0)."""
    x, y = (df.groupBy(F.col(by).alias("k")).agg(F.count("*").alias(n)) for df, n in ((a, "n_a"), (b, "n_b")))
    out = x.join(y, "k", "full").fillna(0, ["n_a", "n_b"])
    return out.withColumns({"difference": F.col("n_a") - F.col("n_b"), "ratio": F.when(F.col("n_b") == 0, float("inf")).otherwise(F.col("n_a") / F.col("n_b"))})


def shares(rows: DataFrame, by: str = "type") -> DataFrame:
    """Labels by type: total, positive, negative, and their shares in percent."""
    n = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))
    return n.withColumns({"rate": F.round(100.0 * F.col("positive") / F.col("total"), 4), "false_rate": F.round(100.0 * F.col("negative") / F.col("total"), 4)})


def ranked(rows: DataFrame, by: str = "engine") -> DataFrame:
    """Engines with their totals and rates, by rate; engines are few, so one partition ranks them."""
    n = rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if("positive").alias("positive")).withColumn("rate", F.round(100.0 * F.col("positive") / F.col("total"), 4))
    return n.withColumn("place", F.rank().over(Window.orderBy(F.desc("rate"))))


def mapped_names(names: DataFrame, targets: DataFrame, fuzzy: bool = True, least: float = 0.5) -> DataFrame:
    """Rows (name, target): the equal file name, else one of equal base name without folder and extension, else (`fuzzy`) the
    best that holds it or is held: the distinct characters of the shorter base are more than `least` of the longer's length; of equal ones the last by name."""
    base = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^.*/", ""), r"\.[^.]*$", "")
    n, t = names.distinct().withColumn("_b", base("name")), targets.distinct().withColumn("_b", base("target"))
    exact = n.join(t.select(F.col("target").alias("name"), F.col("target").alias("_exact")), "name", "left")
    by_base = t.groupBy("_b").agg(F.min("target").alias("_based"))
    out = exact.join(by_base, "_b", "left").withColumn("target", F.coalesce("_exact", "_based")).select("name", "target", "_b")
    if fuzzy:
        # bases of up to GRAM characters reach `least` only in bases that are hardly longer, which are found by their runs
        one = F.lit(0).alias("_k")
        left, right = out.filter("target is null and _b <> ''").select(one, F.col("_b").alias("_n")).distinct(), t.filter("_b <> ''").select(one, F.col("_b").alias("_t")).distinct()
        fits = lambda short, long: F.size(F.array_distinct(F.split(short, ""))) / F.length(long)
        swapped = lambda df: df.select("_k", F.col("_t" if "_t" in df.columns else "_n").alias("_n" if "_t" in df.columns else "_t"))

        def pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
            brief = needles.filter(F.length("_n") <= GRAM).join(_short(texts.filter(F.length("_t") < GRAM / least), ["_k"], "_t"), ["_k", "_n"])
            return _held_pairs(needles, texts, ["_k"]).unionByName(brief.select("_k", "_n", "_t")).withColumn("_s", fits("_n", "_t")).filter(F.col("_s") > least)

        near = pairs(left, right).select(F.col("_n").alias("_b"), F.col("_t").alias("_o"), "_s").unionByName(pairs(swapped(right), swapped(left)).select(F.col("_t").alias("_b"), F.col("_n").alias("_o"), "_s"))
        best = near.join(t.select(F.col("_b").alias("_o"), F.col("target").alias("_near")), "_o").groupBy("_b").agg(F.max_by("_near", F.struct("_s", "_near")).alias("_near"))
        out = out.join(best, "_b", "left").withColumn("target", F.coalesce("target", "_near"))
    return out.select("name", "target")


def gathered(pages: Column | str) -> Column:
    """The entities of nested answers, pages of texts of entities, as one list."""
    return F.flatten(F.transform(_col(pages), lambda p: F.flatten(F.filter(F.transform(p["text"], lambda t: t["entities"]), lambda e: e.isNotNull()))))
