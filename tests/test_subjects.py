"""Values of logs and identifiers of persons against each pair."""

import random
from collections import Counter

from inkveil.sources import subjects


def how(value, identifier):
    if value is None or not identifier:
        return None
    if value == identifier:
        return "exact"
    if "[" in value and "]" in value and len(identifier) >= 2:
        if (value[0], value[-1]) == (identifier[0], identifier[-1]) or identifier[:2] in value or identifier[-2:] in value:
            return "masked"
    return None


def test_pairs_and_counts(spark):
    rnd = random.Random(7)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(rnd.randrange(n)))
    values = [(i, word("abAé[]", 8)) for i in range(300)] + [(900 + i, "[REDACTED]") for i in range(50)] + [(1000, None), (1001, ""), (1002, "[]"), (1003, "]["), (1004, "a[b]a")]
    who = [(i, word("abAé[]", 6)) for i in range(80)] + [(200, None), (201, ""), (202, "a"), (203, "[]"), (204, "RE"), (204, "RE"), (205, "a[b]a"), (206, "[x]")]
    entries = spark.createDataFrame([(*v, "h", "t") for v in values], "entry_id int, value string, head string, n string")
    people = spark.createDataFrame([(*w, "v", 1) for w in who], "subject_id int, identifier string, value string, n int")
    want = [(e, s, how(v, w)) for e, v in values for s, w in who if how(v, w)]
    got = [tuple(r) for r in subjects.entries_of(entries, people).collect()]
    assert Counter(got) == Counter(want)
    tally = Counter((s, w, sum(how(v, w) == "exact" for _, v in values), sum(how(v, w) == "masked" for _, v in values)) for s, w in who if w)
    assert Counter(tuple(r) for r in subjects.counts(entries, people).collect()) == tally


def test_none(spark):
    entries = spark.createDataFrame([], "entry_id int, value string")
    people = spark.createDataFrame([(1, "ann")], "subject_id int, identifier string")
    assert [tuple(r) for r in subjects.counts(entries, people).collect()] == [(1, "ann", 0, 0)]
    assert subjects.entries_of(entries, people).count() == 0 and subjects.counts(entries, people.limit(0)).count() == 0
