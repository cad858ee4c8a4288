"""Merging the clusters of many images at once against one image after another."""

import random

import numpy as np
import pytest
from skeinframe.functions import labmath
from skeinframe.operators import image

CLUSTER = "image_id long, cluster_id int, r int, g int, b int, population long, protected boolean"


def merged(rows, threshold, ceiling):
    """rows (r, g, b, population, protected, largest) of one image."""
    have = [(np.array(x[:3], float), *x[3:]) for x in rows]
    ratio = lambda a, b: max(a[1], b[1]) / max(1, min(a[1], b[1]))

    def best(cost):
        lab = labmath.rgb_to_lab(np.array([h[0] for h in have] + [[0, 0, 0]]))
        found = [(c, i, j) for i in range(len(have)) for j in range(i + 1, len(have)) if (c := cost(((lab[i] - lab[j]) ** 2).sum(), have[i], have[j])) is not None]
        return min(found, default=None)

    def join(i, j):
        b, a = have.pop(j), have.pop(i)
        wa, wb = max(1, a[1]), max(1, b[1])
        apart = labmath.ciede2000(*labmath.rgb_to_lab(np.array([a[0], b[0]])))
        colour = (a if wa >= wb else b)[0] if apart > 12 else np.floor((a[0] * wa + b[0] * wb) / (wa + wb) + 0.5)
        have.append((colour, a[1] + b[1], a[2] or b[2], max(a[3], b[3])))

    close = lambda d, a, b: d if d < threshold and (d <= threshold / 4 or (ratio(a, b) <= 8 and min(a[3], b[3]) < 8)) else None
    while pair := best(close):
        join(*pair[1:])
    while len(have) > max(1, ceiling):
        forced = sum(not h[2] for h in have) <= ceiling
        join(*best(lambda d, a, b, forced=forced: d * (1 + np.log2(min(ratio(a, b), 64))) if forced or not (a[2] or b[2]) else None)[1:])
    return [(*map(int, h[0]), h[1], h[2]) for h in have]


@pytest.mark.parametrize("threshold,ceiling", [(400.0, 5), (60.0, 2), (0.0, 1), (2000.0, 30)])
@pytest.mark.parametrize("pairs", [1, image.PAIRS])
def test_merges_of_many_images(spark, monkeypatch, threshold, ceiling, pairs):
    """Images of 1 to 14 clusters, some of them equal, with and without patches."""
    monkeypatch.setattr(image, "PAIRS", pairs)
    r = random.Random(ceiling)
    rows = {}
    for i in range(40):
        step = r.choice([1, 12, 60])
        rows[i] = [(*[min(255, r.randrange(0, 256) // step * step) for _ in range(3)], r.choice([1, 5, 40, 900]), r.random() < 0.3, r.choice([0, 7, 8, 30])) for _ in range(r.choice([1, 2, 3, 8, 8, 14]))]
        rows[i] += rows[i][:1] * (i % 2)
    frame = spark.createDataFrame([(i, k, *x[:5]) for i, own in rows.items() for k, x in enumerate(own)], CLUSTER)
    patches = spark.createDataFrame([(i, k, x[5]) for i, own in rows.items() for k, x in enumerate(own) if x[5]], "image_id long, cluster_id int, largest long")
    got = {}
    for q in sorted(image.merge_clusters(frame, threshold, ceiling, patches).collect(), key=lambda q: (q.image_id, q.cluster_id)):
        assert q.cluster_id == len(got.setdefault(q.image_id, []))
        got[q.image_id].append((q.r, q.g, q.b, q.population, q.protected))
    assert got == {i: merged(own, threshold, ceiling) for i, own in rows.items()}


def test_clusters_without_population_go_first(spark):
    rows = [(1, 0, 10, 10, 10, 5, False), (1, 1, 12, 12, 12, 5, False), (1, 2, 250, 0, 0, 0, False), (1, 3, 0, 0, 250, 0, False)]
    got = {(q.r, q.g, q.b, q.population) for q in image.merge_clusters(spark.createDataFrame(rows, CLUSTER), 0.0, 3).collect()}
    assert got == {(10, 10, 10, 5), (12, 12, 12, 5), (250, 0, 0, 0)}


def test_no_call_for_each_image(spark):
    frame = spark.createDataFrame([(1, 0, 1, 2, 3, 4, False)], CLUSTER)
    plan = image.merge_clusters(frame, 400.0, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
