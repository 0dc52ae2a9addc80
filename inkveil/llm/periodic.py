"""Operator 11: runs of words with a short period, by probing a harmonic grid."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: A run has this many periods at least, and this many words at least.
REPEATS, LEAST = 4, 6
#: Grid places that are probed at once.
PROBES = 1 << 20
#: Words that are compared at once where a run is extended; doubled at each step.
CHUNK = 64

RUNS = "array<struct<start: long, length: long, period: long>>"


def blocks_of_periods(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the grid points jp with jp + 3p < n, for p from 1 to `longest`, by period and place, about PROBES at once.

    All periods together have about n ln n points."""
    lo = 1
    while lo <= longest:
        hi = min(longest + 1, lo + max(1, PROBES * lo // n))  # from lo on a period has n / lo points at most
        periods = np.arange(lo, hi, dtype=np.int64)
        counts = (n - 1) // periods - 2
        p = np.repeat(periods, counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        yield (np.arange(len(p)) - first) * p, p
        lo = hi


def agreement(ids: np.ndarray, p: int, at: int, step: int) -> int:
    """How many words from `at` on, in the direction `step`, equal the word `p` later; compared in growing chunks."""
    n, done, size = len(ids) - p, 0, CHUNK
    while True:
        lo, hi = (at + done, min(n, at + done + size)) if step > 0 else (max(0, at - done - size + 1), at - done + 1)
        if lo >= hi:
            return done
        odd = np.flatnonzero(ids[lo:hi] != ids[lo + p : hi + p])
        if len(odd):
            return done + (int(odd[0]) if step > 0 else hi - lo - 1 - int(odd[-1]))
        done += hi - lo
        size *= 2


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of `ids`, by start and period.

    A run of period p and 4p words or more has three neighbouring grid points jp whose word is the one p later, so a point is
    a survivor if the words at jp, (j+1)p, (j+2)p and (j+3)p are equal. Survivors within a run that was found for p or a divisor of p are
    skipped; the others are extended both ways. By ascending period, a stretch that was found before has a smaller period."""
    n = len(ids)
    found: set[tuple[int, int]] = set()
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for places, periods in blocks_of_periods(n, n // REPEATS):
        for k in (1, 2, 3):
            same = ids[places + (k - 1) * periods] == ids[places + k * periods]
            places, periods = places[same], periods[same]
        for p, own in zip(*_groups(places, periods)):
            for q, (starts, ends) in by_period.items():
                if p % q == 0 and len(own):
                    k = np.searchsorted(starts, own, "right") - 1
                    own = own[(k < 0) | (own + 3 * p >= ends[k])]
            at, new = 0, []
            while at < len(own):
                i = int(own[at])
                right, left = agreement(ids, p, i, 1), agreement(ids, p, i, -1)
                start, end = i - left + 1, i + right + p
                if end - start >= max(LEAST, REPEATS * p) and (start, end) not in found:
                    found.add((start, end))
                    new.append((start, end))
                at = int(np.searchsorted(own, i + right))  # the points up to there lie in the same stretch
            if new:
                by_period[p] = tuple(np.array(x) for x in zip(*new))
                out += [(s, e - s, p) for s, e in new]
    return sorted(out, key=lambda r: (r[0], r[2]))


def _groups(places: np.ndarray, periods: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    own, first = np.unique(periods, return_index=True)
    return own.tolist(), np.split(places, first[1:]) if len(own) else []


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words but for those of a run behind its first period, joined by spaces."""
    if not runs:
        return " ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return " ".join(words[i] for i in np.flatnonzero(keep))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, runs, collapsed), one for each row of `docs`.

    Words are runs of characters other than space and 0x09 to 0x0D, numbered from 0. `runs` has the stretches of words with smallest
    period p and max(6, 4p) words or more that can't be extended, by start and period; `collapsed` is the text without the words of a run
    behind its first period, its words joined by single spaces. Null and empty texts have no runs and the collapsed text "". Null and repeated
    ids keep their rows; other columns aren't read. A text is handled whole, by one task, with memory of a few times its words."""
    word = re.compile(WORD)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs, texts = [], []
            for text in pdf["t"]:
                words = word.findall(text or "")
                numbers: dict[str, int] = {}
                r = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in r])
                texts.append(collapsed(words, r))
            yield pd.DataFrame({"doc_id": pdf["id"].astype("Int64"), "runs": runs, "collapsed": texts})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id long, runs {RUNS}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """`text`, for one id in ten with a stretch of its words, from some word to its end, replaced by repetitions of its first words.

    With h the CRC-32 of the id in decimal and g = h div 10: if h is a multiple of 10, word i from a = g mod n on becomes word a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8). Texts without words and rows with a null id stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def damaged(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    return F.when(F.coalesce((h % 10 == 0) & F.rlike(text, F.lit(WORD)), F.lit(False)), F.get(F.transform(F.array(words), damaged), F.lit(0))).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Figures of each row of periodic_runs(): how many runs, the longest (ties: smallest start, then period; nulls without runs), SHA-256 of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    one = found.withColumns({"_best": best, "_lines": F.array_join(lines, "")})
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.p")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.p")).alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
