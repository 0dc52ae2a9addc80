"""Chunks of texts: sentences, groups of sentences, words and boundaries, as columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentences(text: Column | str) -> Column:
    """Sentences, stripped: a text is split at white space after a full stop, an exclamation or a question mark."""
    parts = F.split(_col(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _packed(joined: Column, separator: str, most: int) -> Column:
    """What stands between single separators, in runs of at most `most` characters as long as they can be; a longer part is alone.

    One expression goes over the text once, and back by `most` characters at most for each run."""
    return F.regexp_extract_all(joined, F.lit(f"(?s)[^{separator}].{{0,{most - 1}}}(?![^{separator}])|[^{separator}]+"), F.lit(0))


def word_chunks(text: Column | str, most: int) -> Column:
    """Words of a text in chunks of at most `most` characters; a longer word is a chunk of its own."""
    return _packed(F.array_join(_words(_col(text)), " "), " ", most)


#: A code point that is no character, and so in no text, between sentences.
BETWEEN = "\ufdd0"


def sentence_groups(text: Column | str, most: int = 800) -> Column:
    """Sentences in groups of at most `most` characters; a longer sentence is divided between words and shares no group."""
    groups = _packed(F.array_join(sentences(text), BETWEEN), BETWEEN, most)
    return F.flatten(F.transform(groups, lambda g: F.when(F.length(g) > most, word_chunks(g, most)).otherwise(F.array(F.replace(g, F.lit(BETWEEN), F.lit(" "))))))


def boundary_chunks(text: Column | str, most: int = 10_000, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> Column:
    """Chunks of at most `most` characters, each ending behind its last paragraph break, else line break, else ". ", else space, else at the limit."""

    # of more than `most` characters, the longest stretch that ends with the first separator it can; then the rest. Quoted, so any separator can be given
    ends = "|".join(f".{{0,{most - len(s)}}}\\Q{s}\\E" for s in separators if len(s) <= most)
    expression = f"(?s)(?=.{{{most + 1}}})(?:{ends}{'|' if ends else ''}.{{{most}}})|.{{1,{most}}}"
    t = _col(text)
    return F.when(t == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(t, F.lit(expression), F.lit(0)))


def at_last_space(text: Column | str, most: int = 10_000) -> Column:
    """The first `most` characters of a longer text, up to their last space if there is one."""
    t = _col(text)
    return F.when(F.length(t) <= most, t).otherwise(F.regexp_replace(F.substr(t, F.lit(1), F.lit(most)), r"(?s)^(.*) [^ ]*$", "$1"))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Likeness of two texts: 1 if equal, 0.95 without case, 0.9 by lengths if one holds the other, else common words to the larger number of words."""
    x, y = _col(a), _col(b)
    lx, ly = F.lower(x), F.lower(y)
    wx, wy = F.array_distinct(_words(lx)), F.array_distinct(_words(ly))
    ratio = lambda p, q: F.when(F.length(q) == 0, F.lit(0.0)).otherwise(0.9 * (F.length(p) / F.length(q)))
    words = F.when((F.size(wx) == 0) | (F.size(wy) == 0), 0.0).otherwise(F.size(F.array_intersect(wx, wy)) / F.greatest(F.size(wx), F.size(wy)))
    return F.when(x == y, 1.0).when(lx == ly, 0.95).when(F.contains(ly, lx), ratio(x, y)).when(F.contains(lx, ly), ratio(y, x)).otherwise(words)


# References in which slashes stay.
REFERENCES = r"\b(?:ref|referanse)[:\s]+[A-Za-z0-9\-]+/[A-Za-z0-9\-/]+|\b\d{4}/\d+\b"


def scrubbed(text: Column | str, references: str = REFERENCES) -> Column:
    """A text without asterisks, slashes and backslashes, but for slashes in references."""
    return F.regexp_replace(_col(text), f"({references})|[/\\\\*]", "$1")


def scrub_counts(text: Column | str, references: str = REFERENCES) -> Column:
    """How many slashes, backslashes and asterisks scrubbed() takes out."""
    t, left = _col(text), scrubbed(text, references)
    n = lambda c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) - (F.length(left) - F.length(F.replace(left, F.lit(c), F.lit(""))))
    return F.struct(n("/").alias("slashes"), n("\\").alias("backslashes"), n("*").alias("asterisks"))


def without_brackets(text: Column | str) -> Column:
    """A model's text without an opening bracket at its beginning, a closing one at its end, and pairs of asterisks."""
    return F.trim(F.replace(F.regexp_replace(F.trim(_col(text)), r"^\[\s*|\s*\]$", ""), F.lit("**"), F.lit("")))


def without_fence(text: Column | str) -> Column:
    """A model's JSON without the marks of code fences."""
    return F.trim(F.regexp_replace(_col(text), r"```json\s*|\s*```", ""))


def value_spans(text: Column | str, values: Column | str) -> Column:
    """(value, start, end) of every occurrence, overlapping ones too, of each value in a text."""
    from inkveil.operators.entities import occurrences

    found = F.transform(F.filter(F.array_distinct(_col(values)), lambda v: F.coalesce(v, F.lit("")) != ""), lambda v: F.transform(occurrences(_col(text), v), lambda p: F.struct(v.alias("value"), p.alias("start"), (p + F.length(v)).alias("end"))))
    return F.flatten(found)
