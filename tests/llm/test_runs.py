"""Planted passages of over 50 words in long, wrapped and short lines: all of each goes from every text but the first."""

from inkveil.llm import paragraphs, runs

from test_operators import prose


def wrap(text, n, shift=0):
    w = text.split(" ")
    lines = [w[:shift]] * (shift > 0) + [w[i : i + n] for i in range(shift, len(w), n)]
    return "\n".join(map(" ".join, lines))


def test_planted_passages(spark):
    rows, want, key = [], [], 0
    for n in (51, 60, 75, 120):
        for seed, shape in enumerate([lambda t: t, lambda t: wrap(t, 12), lambda t: wrap(t, 12, 1), lambda t: wrap(t, 12, 2), lambda t: wrap(t, 12, 5), lambda t: wrap(t, 4)]):
            passage = prose(1000 * n + seed, n)
            rows.append((key, prose(5000 + key, 40) + " " + passage + " " + prose(6000 + key, 40)))
            own = [prose(7000 + key, 33), prose(8000 + key, 45)]
            rows.append((key + 1, own[0] + " " + shape(passage).upper() + "\n" + own[1]))
            want += [(key, rows[-2][1].split()), (key + 1, " ".join(own).split())]
            key += 2
    rows += [(900, prose(1, 30) + " " + "vi " * 80 + prose(2, 30)), (901, prose(3, 30) + "\n" + "vi " * 80 + prose(4, 30)), (902, None), (904, "lo " * 200), (903, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = paragraphs.passages(df).filter("removed")
    kept = {r["doc_id"]: (r["text"] or "").split() for r in paragraphs.remove(df, spans).collect()}
    assert [(i, kept[i]) for i, _ in want] == want
    assert kept[901] == (prose(3, 30) + " " + prose(4, 30)).split()
    assert len(kept[904]) >= runs.GRAM


def test_a_phrase_over_and_over_makes_few_chains():
    def chains(raw):
        (_, _, start, end, h), = paragraphs.word_lists([1], [raw])
        chosen = runs.chosen(start, end, h)
        return chosen[0], runs.chains(*chosen[3:])

    for k in range(40):  # some phrases end chains at each of their grams, others never
        phrase = " ".join(prose(300 + k, 7).split()[:7])
        w, (a, b, h) = chains(prose(1, 90) + " " + " ".join([phrase] * 200) + " " + prose(2, 90))
        assert len(a) < 30 and (a[1:] == b[:-1]).all() and (a < b).all() and len(set(h)) >= len(h) - 1
    for text in ("", "a " * 60, prose(4, 50)):
        assert [len(x) for x in chains(text)[1]] == [0, 0, 0]
