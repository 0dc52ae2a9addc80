"""Entities leave a task a few at a time, however many a batch of texts has."""

from inkveil.operators import patterns


def test_few_entities_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a@b.no c@d.no " * 5), (2, None), (3, ""), (None, "x@y.no")], "doc_id long, text string").coalesce(1)
    rows = lambda: sorted(map(str, patterns.detect(docs).collect()))
    want = rows()
    monkeypatch.setattr(patterns, "MOST_FOUND", 3)
    assert rows() == want and len(want) > 10
