import datetime

from chronogrid.operators.joins import asof_nearest


def _most_rows(plan):
    """The most rows that a node of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _most_rows(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _most_rows(plan.plan())
    metrics, children = plan.metrics(), plan.children()
    own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
    return max([own, *(_most_rows(children.apply(i)) for i in range(children.size()))])


def test_rows_of_one_day_are_not_paired(spark):
    day = datetime.date(2001, 5, 6)
    left = spark.createDataFrame([(i, day, i % 2) for i in range(400)], "id long, d date, p int")
    right = spark.createDataFrame([(i, day + datetime.timedelta(days=3 * (i % 2) - 1), i % 2) for i in range(400)] + [(900, None, 0), (901, day, None)], "id long, d date, p int")
    df = asof_nearest(left, right, "d", "d", 45, by="p")
    got = {r.left_id: (r.right_id, r.gap_days) for r in df.collect()}
    assert got == {i: ((0, 1) if i % 2 == 0 else (1, 2)) for i in range(400)}
    assert _most_rows(df._jdf.queryExecution().executedPlan()) <= 1600
    # equally near: the earlier day, then the smaller id; beyond the tolerance: none
    both = spark.createDataFrame([(5, day + datetime.timedelta(days=2)), (7, day - datetime.timedelta(days=2)), (6, day - datetime.timedelta(days=2))], "id long, d date")
    one = spark.createDataFrame([(1, day)], "id long, d date")
    assert [tuple(r) for r in asof_nearest(one, both, "d", "d", 45).collect()] == [(1, 6, 2)]
    assert asof_nearest(one, both, "d", "d", 1).collect() == []
