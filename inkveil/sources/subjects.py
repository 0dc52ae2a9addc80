"""Log values joined to the identifiers of many persons, also where a value was masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(value: Column) -> Column:
    """Whether a value counts as masked: it has both square brackets."""
    return F.coalesce(value.contains("[") & value.contains("]") & (F.length(value) >= 2), F.lit(False))


def _grams(value: Column) -> Column:
    """The distinct pairs of neighbouring characters of a text of two or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substr(value, i, F.lit(2))))


def _identified(subjects: DataFrame) -> DataFrame:
    rows = subjects.select("subject_id", F.col("identifier").cast("string").alias("identifier")).filter("identifier <> ''")
    long = F.length("identifier") >= 2
    return rows.withColumns({"head": F.when(long, F.substr("identifier", F.lit(1), F.lit(2))), "tail": F.when(long, F.substring("identifier", -2, 2))})


def links(values: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct (value, head, tail): the masked values that may stand for identifiers with this head and tail.

    A masked value may stand for an identifier if it holds its first or last two characters, or begins and ends as it does.
    Only an identifier's head and tail count, so distinct values meet distinct (head, tail) through equal signatures, and
    neither many equal values nor many persons alike make more rows."""
    kinds = _identified(subjects).filter("head is not null").select("head", "tail").distinct()
    ends = F.concat(F.lit("e"), F.substring("head", 1, 1), F.substring("tail", 2, 1))
    kinds = kinds.withColumn("_sign", F.explode(F.array_distinct(F.array(F.concat(F.lit("g"), "head"), F.concat(F.lit("g"), "tail"), ends))))
    v = F.col("value")
    own = F.concat(F.lit("e"), F.substring(v, 1, 1), F.substring(v, -1, 1))
    signed = values.select(v.cast("string").alias("value")).filter(masked(v)).distinct()
    signed = signed.withColumn("_sign", F.explode(F.concat(F.transform(_grams(v), lambda g: F.concat(F.lit("g"), g)), F.array(own))))
    return signed.join(kinds, "_sign").select("value", "head", "tail").distinct()


def counts(entries: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows (subject_id, identifier, exact, masked): how many entries (value) equal a person's identifier, and how many others may be it, masked.

    Letters count as they are. Null values and null or empty identifiers match nothing, identifiers of one character only
    exactly; repeated entries and persons count each for themselves, persons without entries have zeros."""
    tally = entries.select(F.col("value").cast("string").alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    found = links(tally, subjects).join(tally, "value").groupBy("head", "tail").agg(F.sum("n").alias("_m"))
    # a value that equals an identifier and is masked too is an exact match for it, and no other
    same = tally.select(F.col("value").alias("identifier"), F.col("n").alias("_e"), masked(F.col("value")).alias("_both"))
    rows = _identified(subjects).join(same, "identifier", "left").join(found, ["head", "tail"], "left")
    exact = F.coalesce("_e", F.lit(0))
    other = F.coalesce("_m", F.lit(0)) - F.when(F.col("_both") & F.col("head").isNotNull(), exact).otherwise(0)
    return rows.select("subject_id", "identifier", exact.alias("exact"), other.alias("masked"))


def entries_of(entries: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows (entry_id, subject_id, how): each entry (entry_id, value) with each person it may be of, exactly or masked.

    The result has a row for each such pair; where most values are masked, take `counts` or `links` instead."""
    who = _identified(subjects)
    rows = entries.select("entry_id", F.col("value").cast("string").alias("value"))
    exact = rows.join(who, F.col("value") == F.col("identifier")).select("entry_id", "subject_id", F.lit("exact").alias("how"))
    near = rows.join(links(rows, subjects), "value").join(who, ["head", "tail"]).filter("value <> identifier")
    return exact.unionByName(near.select("entry_id", "subject_id", F.lit("masked").alias("how")))
