"""How near boxes are joined."""

import __spark_entry__


def test_near_boxes_are_not_sent_through_the_driver(spark):
    plan = __spark_entry__.queries()["near_equal_boxes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
