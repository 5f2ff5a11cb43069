from geoloom.operators import cellsets
from pyspark.sql import functions as F


def test_perimeter_by_edges_without_a_join(spark):
    cells = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 0, 2), (2, 5, 5)], "fid long, rr long, cc long")
    got = cellsets.perimeter(cells, "fid")
    assert {r.fid: r.perimeter for r in got.collect()} == {1: 8, 2: 8}
    # cells from few areas look small to the planner, which then broadcast them all
    boxes = spark.range(5).select(F.col("id").alias("fid"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(40.0).alias("x1"), F.lit(20.0).alias("y1"))
    wide = cellsets.perimeter(cellsets.box_cells(boxes, 4.0, "fid"), "fid")
    assert "Join" not in wide._jdf.queryExecution().optimizedPlan().toString()
    assert {r.perimeter for r in wide.collect()} == {30}
