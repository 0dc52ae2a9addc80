"""First boxes of a word are found where the document is."""

from inkveil.plans.catalogue import QUERIES


def test_words_of_a_document_are_not_shuffled(spark):
    assert "Exchange" not in QUERIES["dedup_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
