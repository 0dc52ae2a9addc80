import corpus_pipeline
from inkveil.llm import common


def test_stages(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] * 0.6
    assert docs.join(docs.groupBy("doc_id").count().filter("count > 1"), "doc_id").count() == 0
