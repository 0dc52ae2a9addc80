"""Exact repeated runs of over 50 words, wherever lines break: winnowed word grams, linked through equal stretches between them and extended word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, probable, tidy
from .paragraphs import MIX, _mix, word_lists

#: Words of a gram and grams of a window: a run of GRAM + WINDOW - 1 = 51 words holds a chosen gram.
GRAM, WINDOW = 12, 40
#: Shorter runs are no passages.
LEAST = GRAM + WINDOW - 1
#: In a stretch of equal grams (one word over and over), one in so many is taken.
THIN = 20
#: Grams between the ends of chains, on average.
CHAIN = 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM words from each word on, joined from halves."""
    power, out, width = h, None, 1
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            if out is None:
                out, size = power, width
            else:
                n = len(h) - size - width + 1
                out, size = _mix(out[:n] * MIX[0] + power[size : size + n]), size + width
        n = len(h) - 2 * width + 1
        power, width = _mix(power[:n] * MIX[3] + power[width : width + n]), 2 * width
    return out


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = pick(x[: len(x) - size], x[size:])
        size *= 2
    return pick(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def chosen(start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's chosen grams, those least in a window: word, byte start, byte end, hash, and the hash of the words up to the end of the next one (0: none).

    Equal runs have equal grams chosen wherever they stand, but for windows over their ends."""
    if len(h) < LEAST:
        return (np.zeros(0, np.int32),) * 3 + (np.zeros(0, np.int64),) * 2
    g = grams(h)
    least = _slide(g, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, np.uint64)
    at = np.nonzero(_slide(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == g)[0]
    again = (np.diff(at, prepend=-2) == 1) & (g[at] == g[at - 1])
    if again.any():
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
        at = at[since % THIN == 0]
    n = len(h)
    down, up = np.cumprod(np.full(n, _INVERSE)), np.cumprod(np.full(n, _BASE))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up)])
    stretch = np.zeros(len(at), np.uint64)
    if len(at) > 1:
        stop = at[1:] + GRAM
        stretch[:-1] = _mix((sums[stop] - sums[at[:-1]]) * down[at[:-1]] + (stop - at[:-1]).astype(np.uint64)) | np.uint64(1)
    return at.astype(np.int32), start[at].astype(np.int32), end[at + GRAM - 1].astype(np.int32), g[at].view(np.int64), stretch.view(np.int64)


def chains(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains of neighbouring stretches of a text: places of the first and last gram, and the hash of the stretches.

    Chains meet at about one gram in CHAIN, chosen by its hash, so equal runs have equal chains but for those over their ends. Of equal
    neighbours, as in a phrase over and over, all but the first are one: each of them occurs before, and so does what they cover together."""
    cuts = np.nonzero(_mix(g.view(np.uint64)) % np.uint64(CHAIN) == 0)[0]
    h = np.array([xxhash.xxh64_intdigest(c[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.uint64)
    again = np.diff(h, prepend=~h[:1]) == 0
    keep = ~(again & np.append(False, again[:-1]))
    last = np.append(np.nonzero(keep)[0][1:], len(h))
    return cuts[:-1][keep].astype(np.int32), cuts[last[: keep.sum()]].astype(np.int32), h[keep].view(np.int64)


def around(h: np.ndarray, start: np.ndarray, end: np.ndarray, w: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words beside the gram at word `w`, nearest first, and the bytes where each of them ends (on the left: starts)."""
    if right:
        s = slice(w + GRAM, w + GRAM + WINDOW)
        return h[s], end[s]
    s = slice(max(0, w - WINDOW), w)
    return h[s][::-1], start[s][::-1]


def in_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words that two contexts have in common from their beginnings on."""
    out = []
    for x, y in zip(a, b):
        n = min(len(x), len(y)) // 8
        differ = np.nonzero(np.frombuffer(x, np.int64, n) != np.frombuffer(y, np.int64, n))[0]
        out.append(int(differ[0]) if len(differ) else n)
    return pd.Series(out, dtype="int32")


def runs(texts: DataFrame, src: DataFrame) -> DataFrame:
    """Rows like those of `paragraphs.passages` for runs of over 50 words that occur before, by id and place; they are `removed`.

    Besides, there is a row, not `removed`, for the first gram of each place where such a run was seen first.

    texts: rows of `paragraphs.prints`; src: (u, doc_id, t), their texts. Grams that occur once are left out by a join. Each
    other occurrence of a gram is compared with an earlier one: if the stretch to the next (or from the last) chosen gram
    occurs earlier too, it is covered whole; else the words beside the gram are compared one by one with those beside the
    first occurrence that shares the stretch on the other side, or else with the gram's first occurrence. What is covered is
    joined to runs; those over 50 words count. So a run with two or more chosen grams is found whole; of a run with a
    single one, a part can stay if that gram's first occurrence stands among other words.

    Chains of several stretches are looked up first. One that occurs before is covered whole, and grams within it, or between two such
    chains, aren't looked up themselves, so copies of long runs cost a row for each chain and not for each gram.

    Groups are only aggregated to their least member, which is joined back; contexts are cut to WINDOW words.
    """
    at = lambda c, i: F.get(F.col(c), F.col(i))
    links = texts.select("u", "doc_id", "w", "start", "stop", F.explode(F.arrays_zip("k_from", "k_to", "k_hash")).alias("x")).select("u", "doc_id", "w", "start", "stop", F.col("x.k_from").alias("a"), F.col("x.k_to").alias("b"), F.col("x.k_hash").alias("k"))
    links = links.select("doc_id", "u", "a", "b", "k", at("w", "a").alias("w"), at("start", "a").alias("start"), at("stop", "a").alias("stop"), at("w", "b").alias("w_last"), at("stop", "b").alias("stop_last"))
    here = F.struct("doc_id", "u", "w", "start", "stop")
    earlier = cut(links.groupBy("k").agg(F.min(here).alias("f"), F.count("*").alias("n")).filter("n > 1").select("k", "f"), "chains")
    seen = cut(probable(links, "k", earlier).join(earlier, "k").filter(here > F.col("f")), "seen")
    by_text = cut(seen.groupBy("u").agg(F.collect_list(F.struct("a", "b")).alias("seen")), "seen")

    def left_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, seen in zip(pdf["n"], pdf["seen"]):
                right, left = np.zeros(n, bool), np.zeros(n, bool)  # the stretch behind, before a gram is in a chain that was seen
                for x in seen:
                    right[x["a"] : x["b"]] = True
                    left[x["a"] + 1 : x["b"] + 1] = True
                out.append(np.nonzero(~(left & right))[0].astype(np.int32))
            yield pd.DataFrame({"u": pdf["u"], "i": out})

    part = ["u", "doc_id", "w", "start", "stop", "g", "c"]
    places = probable(texts.select("u", F.size("g").alias("n")), "u", by_text).join(by_text, "u").mapInPandas(tidy(left_over), "u long, i array<int>")
    whole = F.sequence(F.lit(0), F.size("g") - 1)
    some = texts.filter("size(g) > 0").select(*part)
    texts = probable(some, "u", by_text).join(cut(places, "places"), "u", "left").withColumn("i", F.coalesce("i", whole)).unionByName(probable(some, "u", by_text, absent=True).withColumn("i", whole))

    def beside(c: str, by: int):
        return F.get(F.col(c), F.col("i") + by)

    flat = texts.withColumn("i", F.explode("i"))
    flat = flat.select(
        "u", "doc_id", beside("g", 0).alias("g"), beside("w", 0).alias("w"), beside("start", 0).alias("start"), beside("stop", 0).alias("stop"), beside("c", 0).alias("c"), F.coalesce(beside("c", -1), F.lit(0)).alias("cp"),
        beside("w", -1).alias("w_before"), beside("start", -1).alias("start_before"), beside("w", 1).alias("w_after"), beside("stop", 1).alias("stop_after"),
    )
    many = cut(flat.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "often")
    held = cut(probable(flat, "g", many).join(many, "g"), "held")
    me = F.struct("doc_id", "u", "w", "start", "stop")
    # written first, so that the joins' partitions can be split where a gram is very common
    first = cut(held.groupBy("g").agg(F.min(me).alias("f")), "firsts")
    after = cut(held.filter("c <> 0").groupBy("g", "c").agg(F.min(me).alias("fr")), "firsts")
    before = cut(held.filter("cp <> 0").groupBy("g", "cp").agg(F.min(me).alias("fl")), "firsts")
    gone = held.join(first, "g").filter(me > F.col("f")).join(after, ["g", "c"], "left").join(before, ["g", "cp"], "left")
    right, left = F.coalesce(F.col("fr") < me, F.lit(False)), F.coalesce(F.col("fl") < me, F.lit(False))
    gone = cut(gone.withColumns({"right": right, "left": left}), "gone")
    covered = gone.select(
        "u", "doc_id", F.when(F.col("left"), F.col("w_before")).otherwise(F.col("w")).alias("lo"), (F.when(F.col("right"), F.col("w_after")).otherwise(F.col("w")) + GRAM).alias("hi"),
        F.when(F.col("left"), F.col("start_before")).otherwise(F.col("start")).alias("start"), F.when(F.col("right"), F.col("stop_after")).otherwise(F.col("stop")).alias("stop"), "f",
    )
    # sides that are open: (u, w, right) and the occurrence to compare with
    to_right = F.when(~F.col("right"), F.struct(F.lit(True).alias("right"), F.when(F.col("left"), F.col("fl")).otherwise(F.col("f")).alias("p")))
    to_left = F.when(~F.col("left"), F.struct(F.lit(False).alias("right"), F.when(F.col("right"), F.col("fr")).otherwise(F.col("f")).alias("p")))
    asks = gone.select("u", "w", F.explode(F.filter(F.array(to_right, to_left), lambda x: x.isNotNull())).alias("x")).select("u", "w", "x.right", F.col("x.p.u").alias("pu"), F.col("x.p.w").alias("pw"), F.lit(True).alias("mine"))
    theirs = asks.select(F.col("pu").alias("u"), F.col("pw").alias("w"), "right").distinct().withColumns({"pu": F.lit(0).cast("long"), "pw": F.lit(0), "mine": F.lit(False)})
    wanted = cut(asks.unionByName(theirs).groupBy("u").agg(F.collect_list(F.struct("w", "right", "pu", "pw", "mine")).alias("own")), "wanted")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (u, doc_id, own), _, start, end, h in word_lists(zip(pdf["u"], pdf["doc_id"], pdf["own"]), pdf["t"]):
                for x in own:
                    w = x["w"]
                    words, at = around(h, start, end, w, x["right"])
                    rows.append((u, doc_id, w, x["right"], x["mine"], x["pu"], x["pw"], words.tobytes(), at if x["mine"] else at[:0], int(start[w]), int(end[w + GRAM - 1])))
            yield pd.DataFrame(rows, columns=["u", "doc_id", "w", "right", "mine", "pu", "pw", "words", "at", "start", "stop"])

    schema = "u long, doc_id long, w int, right boolean, mine boolean, pu long, pw int, words binary, at array<int>, start int, stop int"
    near = cut(probable(src, "u", wanted).join(wanted, "u").mapInPandas(tidy(contexts), schema).dropDuplicates(["u", "w", "right", "mine"]), "contexts")
    other = near.filter("not mine").select(F.col("u").alias("pu"), F.col("w").alias("pw"), "right", F.col("words").alias("theirs"))
    far = near.filter("mine").join(other, ["pu", "pw", "right"]).withColumn("n", F.pandas_udf(in_common, "int")("words", "theirs")).filter("n > 0")
    reached = far.select(
        "u", "doc_id", F.when(F.col("right"), F.col("w")).otherwise(F.col("w") - F.col("n")).alias("lo"), (F.col("w") + GRAM + F.when(F.col("right"), F.col("n")).otherwise(0)).alias("hi"),
        F.when(F.col("right"), F.col("start")).otherwise(F.expr("at[n - 1]")).alias("start"), F.when(F.col("right"), F.expr("at[n - 1]")).otherwise(F.col("stop")).alias("stop"),
    )
    by = Window.partitionBy("u").orderBy("lo", "hi")
    chained = seen.select("u", "doc_id", F.col("w").alias("lo"), (F.col("w_last") + GRAM).alias("hi"), "start", F.col("stop_last").alias("stop"), "f")
    out = covered.unionByName(chained).unionByName(reached, allowMissingColumns=True)
    out = out.withColumn("new", F.coalesce(F.col("lo") > F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    out = out.withColumn("run", F.sum(F.col("new").cast("int")).over(by))
    out = out.groupBy("doc_id", "u", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("hi") - F.min("lo")).alias("n_words"), F.min("f").alias("f"))
    out = cut(out.filter(F.col("n_words") >= LEAST), "runs")
    length, place = (F.col("stop") - F.col("start")).alias("length"), [F.col("f.doc_id").alias("cluster_doc_id"), F.col("f.start").alias("cluster_start")]
    kept = out.select("f.doc_id", "f.start", (F.col("f.stop") - F.col("f.start")).alias("length"), F.lit(GRAM).alias("n_words"), *place, F.lit(False).alias("removed")).distinct()
    return out.select("doc_id", "start", length, "n_words", *place, F.lit(True).alias("removed")).unionByName(kept)
