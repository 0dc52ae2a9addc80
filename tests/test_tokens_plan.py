"""Tokens are placed where the text is, and entities come to a document's tokens, which stay in one row."""

from inkveil.operators import tokens


def test_tokens_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "ab c. d"), (2, None), (3, " ")], "doc_id long, text string")
    rows = tokens.tokens(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == [(1, 0, 0, 2, 4), (1, 1, 3, 4, 4), (1, 2, 4, 5, 4), (1, 3, 6, 7, 4)]
    found = spark.createDataFrame([(1, "T", 0, 4), (1, "T", 0, 4), (1, "T", 2, 5), (1, "T", 5, 6), (1, "T", 3, 9), (1, "T", 4, 4), (3, "T", 0, 1)], "doc_id long, entity_type string, start int, end int")
    want = [(1, "T", 0, 4, 0, 1, 4), (1, "T", 2, 5, 1, 2, 4)]
    for own in (tokens.pieces(docs), rows):
        assert sorted(map(tuple, tokens.aligned(found, own).collect())) == want
