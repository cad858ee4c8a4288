"""Merging of colour clusters: worked cases of each rule."""

from skeinframe.operators import image

CLUSTER = "image_id long, cluster_id int, r int, g int, b int, population long, protected boolean"


def merged(spark, rows, threshold, ceiling, patches=None):
    frame = spark.createDataFrame([(1, i, *x) for i, x in enumerate(rows)], CLUSTER)
    extra = None if patches is None else spark.createDataFrame([(1, i, n) for i, n in enumerate(patches)], "image_id long, cluster_id int, largest long")
    return sorted((x.r, x.g, x.b, x.population, x.protected) for x in image.merge_clusters(frame, threshold, ceiling, extra).collect())


def test_rules_of_merging(spark):
    red = (200, 0, 0, 5, False)
    # greys 1 apart: squared Lab distance about 0.15; greys 4 apart: about 2.4
    near = [(100, 100, 100, 100, False), (101, 101, 101, 300, True), red]
    assert merged(spark, near, 4.0, 9) == [(101, 101, 101, 400, True), red]
    uneven = [(100, 100, 100, 900, False), (104, 104, 104, 100, False)]
    assert merged(spark, uneven, 4.0, 9) == sorted(uneven)  # 9 to 1 and beyond a quarter of the threshold
    assert merged(spark, uneven, 16.0, 9) == [(100, 100, 100, 1000, False)]  # within a quarter
    even = [(100, 100, 100, 100, False), (104, 104, 104, 100, False)]
    assert merged(spark, even, 4.0, 9) == [(102, 102, 102, 200, False)]
    assert merged(spark, even, 4.0, 9, [8, 8]) == sorted(even)  # both have patches
    assert merged(spark, even, 4.0, 9, [8, 7]) == [(102, 102, 102, 200, False)]
    assert merged(spark, even, 0.0, 1) == [(102, 102, 102, 200, False)]  # the ceiling holds in any case
    far = [(255, 0, 0, 10, False), (0, 0, 255, 30, False)]
    assert merged(spark, far, 0.0, 1) == [(0, 0, 255, 40, False)]  # no mixture of colours that differ
