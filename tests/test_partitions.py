"""Street space and sea on small nets."""

from geoloom.operators import partitions as S


def lines(spark, rows, more=""):
    return spark.createDataFrame(rows, "ax double, ay double, bx double, by double" + more)


def ring(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def test_streets_by_kerbs_and_axes(spark):
    streets = spark.createDataFrame([(1, ring(0, 0, 20, 10)), (2, ring(15, 0, 30, 10)), (3, ring(50, 0, 60, 10))], "fid long, ring array<struct<x: double, y: double>>")
    kerbs = lines(spark, [(-2.0, 3.0, 32.0, 3.0, False), (-1.0, 7.0, 31.0, 7.0, True), (0.0, 10.0, 30.0, 10.0, True), (30.0, 7.0, 30.0, 10.0, True), (58.0, 0.0, 58.0, 10.0, False)], ", unpaved boolean")
    # an axis that ends inside, one of 1.5 m only, and one outside
    axes = lines(spark, [(5.0, 5.0, 12.0, 5.5), (50.0, 5.0, 51.5, 5.0), (70.0, 0.0, 80.0, 0.0)])
    got = {(round(r.x, 2), round(r.y, 2)): (round(r.area, 2), round(r.axis, 2), r.kind) for r in S.split_streets(streets, kerbs, axes).collect()}
    assert got == {(0.0, 0.0): (90.0, 0.0, "sidewalk"), (0.0, 3.0): (120.0, 7.02, "carriageway"), (0.0, 7.0): (90.0, 0.0, "green"), (50.0, 0.0): (80.0, 1.5, "sidewalk"), (58.0, 0.0): (20.0, 0.0, "sidewalk")}


def test_axis_across_a_part(spark):
    streets = spark.createDataFrame([(1, ring(0, 0, 30, 10))], "fid long, ring array<struct<x: double, y: double>>")
    kerbs = lines(spark, [(0.0, 4.0, 30.0, 4.0, False)], ", unpaved boolean")
    axes = lines(spark, [(10.0, -5.0, 10.0, 15.0), (20.0, -5.0, 20.0, 15.0), (0.0, 7.0, 30.0, 7.0)])
    got = sorted((round(r.area, 2), round(r.axis, 2), r.kind) for r in S.split_streets(streets, kerbs, axes).collect())
    assert got == [(120.0, 8.0, "carriageway"), (180.0, 42.0, "carriageway")]


def test_sea_is_right_of_the_coast(spark):
    # a coast from south to north: land on its left, in the west; an island in the sea, a lake's shore that runs the other way round
    coast = [(50.0, -10.0, 50.0, 110.0)]
    island = [(70.0, 20.0, 90.0, 20.0), (90.0, 20.0, 90.0, 40.0), (90.0, 40.0, 70.0, 40.0), (70.0, 40.0, 70.0, 20.0)]
    inlet = [(10.0, 60.0, 10.0, 80.0), (10.0, 80.0, 30.0, 80.0), (30.0, 80.0, 30.0, 60.0), (30.0, 60.0, 10.0, 60.0)]
    got = {(r.x, r.y): (round(r.area, 2), r.sea) for r in S.sea_faces(lines(spark, coast + island + inlet), (0.0, 0.0, 100.0, 100.0)).collect()}
    assert got == {(0.0, 0.0): (4600.0, False), (50.0, 0.0): (4600.0, True), (70.0, 20.0): (400.0, False), (10.0, 60.0): (400.0, True)}
    assert [(r.area, r.sea) for r in S.sea_faces(lines(spark, [(200.0, 0.0, 200.0, 9.0)]), (0.0, 0.0, 10.0, 10.0)).collect()] == [(100.0, False)]
