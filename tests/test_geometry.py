import math

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from emrecon.functions import geometry as G


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), st.integers(0, 50)), min_size=1, max_size=20))
def test_voxels_there_and_back(spark, points):
    df = spark.createDataFrame([(*p,) for p in points], "x long, y long, z long")
    df = df.withColumn("n", G.voxel_number("x", "y", "z", 13, 7)).withColumn("p", G.voxel_of("n", 13, 7))
    for r in df.collect():
        assert (r.p.x, r.p.y, r.p.z) == (r.x, r.y, r.z)


def test_vectors(spark):
    df = spark.createDataFrame([(3.0, 4.0, 0.0), (0.0, 0.0, 0.0)], "x double, y double, z double").withColumn("a", G.vec("x", "y", "z"))
    df = df.select(G.norm("a").alias("n"), G.unit("a").alias("u"), G.cross("a", G.vec(0, 0, 1)).alias("c"), G.as_text("x", "y").alias("t"), G.from_sphere(0.0, math.pi / 2).alias("s"))
    one, zero = df.collect()
    assert (one.n, one.u.x, one.u.y, one.c.x, one.c.y) == (5, 0.6, 0.8, 4, -3)
    assert (zero.n, zero.u.x, one.t) == (0, 0, "(3.0, 4.0)")
    assert abs(one.s.x - 1) < 1e-12


def test_large_voxel_numbers_are_exact(spark):
    n = 2**53 + 1
    row = spark.range(1).select(G.voxel_of(F.lit(n), 1, 1).alias("p"), G.voxel_of(F.lit(n), 3, 5).alias("q")).first()
    assert row.p.z == n and (row.q.x, row.q.y, row.q.z) == (n % 3, n % 15 // 3, n // 15)
