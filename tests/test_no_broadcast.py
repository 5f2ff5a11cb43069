"""Places are shuffled: written tables pack so well that the planner would send millions of rows through the driver."""

from geoloom.operators import spatial_join as J


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_sends_no_places_through_the_driver(spark, monkeypatch):
    p = spark.range(400).selectExpr("id", "double(id % 20) x", "double(id div 20) y")
    others = spark.range(50).selectExpr("double(id % 10) * 2 + 0.3 rx", "double(id div 10) * 4 ry")
    plans, whole = [], J.written
    monkeypatch.setattr(J, "written", lambda df: plans.append(_plan(df)) or whole(df))
    got = J.nearest(p, others, "id", 3.0)
    plans.append(_plan(got))
    assert sum("Join" in x for x in plans) >= 5 and not any("Broadcast" in x for x in plans)
    want = {r.id: r.d for r in p.crossJoin(others).selectExpr("id", "sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)) d").where("d <= 3").groupBy("id").min("d").toDF("id", "d").collect()}
    assert {r.id: r.distance for r in got.collect()} == want
