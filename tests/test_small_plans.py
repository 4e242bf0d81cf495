"""Plans stay small: the driver's memory grows with the largest one."""

from pyspark.sql import functions as F

from chronopanel.operators import features as X
from chronopanel.operators.panel import CELL_SUMS, FORMATS
from chronopanel.sources.tables import cut_each, drop_cut


def test_features_are_planned_apart(spark):
    cell = [(c, t, k, (t + k) % 2) for c in (1, 2) for t in range(4) for k in range(3)]
    cells = spark.createDataFrame(cell, "course_id long, t int, k long, y long").select("*", *[F.lit(1.0).alias(c) for c in CELL_SUMS if c != "y"])
    formats = cells.select("course_id", "t", "k", *[F.lit(1).cast("long").alias(f) for f in FORMATS])
    items = cells.select("course_id", "k").distinct()
    statics = items.select("*", F.lit("a title").alias("title"), *[F.lit(0.5).alias(c) for c in ("hours_share", "marks_weight_share", "breadth")])
    made = []
    x = X.all_features(cells, formats, statics, X.item_similarity(statics), items.withColumn("unit", F.col("k") % 2), made)
    assert x.count() == 2 * 3 * 3 and len(made) == 5
    assert x._jdf.queryExecution().executedPlan().toString().count("Exchange ") < 25
    for df in made:
        drop_cut(df)


def test_parts_written_one_by_one_are_their_union(spark):
    a, b = spark.createDataFrame([(1, "x", 2)], "k long, model string, score int"), spark.createDataFrame([("y", 0.5, 2)], "model string, score double, k int")
    got = cut_each([a, b, a.limit(0)])
    assert got.dtypes == a.unionByName(b).dtypes and sorted(map(tuple, got.collect())) == [(1, "x", 2.0), (2, "y", 0.5)]
    drop_cut(got)
