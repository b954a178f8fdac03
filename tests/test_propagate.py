import numpy as np

from kinsift.operators import propagate

EDGE = "a long, b long, n_in int, m0 double, m1 double, m2 double, m3 double, m4 double, m5 double"


def shift(a, b, x, y, n=9):
    return (a, b, n, 1.0, 0.0, float(x), 0.0, 1.0, float(y))


def test_maps_are_composed_through_the_root(spark):
    df = spark.createDataFrame([shift(1, 2, 5, 0), shift(2, 3, 0, 7), shift(10, 11, 1, 1)], EDGE)
    found = propagate.composed_pairs(df, 100).collect()
    assert [(r["a"], r["b"]) for r in found] == [(1, 3)] and np.allclose(found[0][2:], [1, 0, 5, 0, 1, 7])


def test_budget_leaves_stars(spark):
    chain = [shift(i, i + 1, 1, 0) for i in range(6)]
    df = spark.createDataFrame(chain, EDGE)
    full, star = propagate.composed_pairs(df, 100).count(), propagate.composed_pairs(df, 0).count()
    assert full == 21 - 6 and star == 4


def test_rounds_end(spark):
    df = spark.createDataFrame([shift(1, 2, 5, 0), shift(2, 3, 0, 7)], EDGE)
    from pyspark.sql import functions as F

    known = propagate.propagate(df, lambda asked: asked.withColumn("n_in", F.lit(0)).select(*df.columns))
    assert known.filter("how = 'propagated'").count() == 1
    weaker = spark.createDataFrame([(1, 3), (1, 9)], "a long, b long")
    assert [(r["a"], r["b"]) for r in propagate.corroborated(df.select("a", "b"), weaker).collect()] == [(1, 3)]
