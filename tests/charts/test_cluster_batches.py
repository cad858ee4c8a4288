"""Clusters of many images at once against one image after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from skeinframe.functions import labmath
from skeinframe.operators import image

PIXEL = "image_id long, idx long, r int, g int, b int, flat boolean"


def median_cut(rgb, target):
    boxes = [rgb] if len(rgb) else []
    while len(boxes) < target:
        spread = [np.ptp(b, axis=0).max() * len(b) for b in boxes]
        if not boxes or max(spread) <= 0:
            break
        box = boxes.pop(int(np.argmax(spread)))
        box = box[np.argsort(box[:, int(np.ptp(box, axis=0).argmax())], kind="stable")]
        boxes += [box[: len(box) // 2], box[len(box) // 2 :]]
    return boxes


def representative(box):
    mean = np.floor(box.mean(axis=0) + 0.5)
    lab = labmath.rgb_to_lab(box[:: max(1, len(box) // 64)])
    if len(box) < 4 or labmath.ciede2000(labmath.rgb_to_lab(mean), lab).max() <= 12:
        return mean
    rest, best = box[:: max(1, len(box) // 512)], []
    while len(rest):
        close = labmath.ciede2000(labmath.rgb_to_lab(rest[0]), labmath.rgb_to_lab(rest)) <= 6
        best = rest[close] if close.sum() > len(best) else best
        rest = rest[~close]
    return np.floor(np.mean(best, axis=0) + 0.5)


def derived(pixels, target, floor):
    """(r, g, b, population, protected) of one image in order."""
    own = [p for p in sorted(pixels) if floor is None or not (min(p[1:4]) >= floor and max(p[1:4]) - min(p[1:4]) <= 8)]
    flat = [p for p in own if p[4]]
    own = flat if len(flat) >= max(200, 0.05 * len(own)) else own
    rgb = np.array([p[1:4] for p in own] or [(255, 255, 255)])
    lab = labmath.rgb_to_lab(rgb)
    chroma, hue = np.hypot(lab[:, 1], lab[:, 2]), np.degrees(np.arctan2(lab[:, 2], lab[:, 1])) % 360 // 60
    vivid = (chroma >= 20) & (chroma >= sorted(chroma)[min(len(rgb) - 1, int(0.8 * len(rgb)))])
    groups = [g for h in range(6) if (g := vivid & (hue == h)).sum() >= max(4, 0.002 * len(rgb))][: max(1, target // 3)]
    free = ~np.any([*groups, np.zeros(len(rgb), bool)], axis=0)
    bands = [m for k in range(8) if (m := free & (chroma <= 6) & (lab[:, 0] // 18 == k)).sum() >= max(20, 0.0015 * len(rgb))]
    groups += bands[:1] + sorted(bands[1:], key=lambda m: -m.sum())[:1] if len(rgb) >= 50 else []
    free = ~np.any([*groups, np.zeros(len(rgb), bool)], axis=0)
    boxes = [(rgb[g], True) for g in groups] + [(b, False) for b in median_cut(rgb[free], max(1, target - len(groups)))]
    return [(*map(int, representative(b)), len(b), p) for b, p in boxes]


def images(seed):
    """Of 1 to 900 pixels: noise, few colours, greys, white only, with and without flat pixels."""
    r, out = random.Random(seed), []
    for i in range(60):
        kinds = [lambda: [r.randrange(256) for _ in range(3)], lambda: r.choice([(250, 10, 10), (20, 200, 30), (9, 9, 9), (128, 128, 128), (90, 40, 200)]), lambda: [r.choice([20, 90, 91, 200, 255])] * 3, lambda: (255, 255, 254)]
        out += [(i, p, *kinds[i % 4](), r.random() < (0, 0.4)[i % 2]) for p in range(r.choice([1, 3, 49, 50, 64, 300, 900]))]
    return out


@pytest.mark.parametrize("target,floor,flat", [(8, None, None), (3, 244, "flat"), (24, 244, None)])
def test_derived_clusters_of_many_images(spark, target, floor, flat):
    rows = images(target)
    made = image.derive_clusters(spark.createDataFrame(rows, PIXEL), target, skip_white=floor, flat=flat)
    got = {}
    for q in sorted(made.collect(), key=lambda q: (q.image_id, q.cluster_id)):
        assert q.cluster_id == len(got.setdefault(q.image_id, []))
        got[q.image_id].append((q.r, q.g, q.b, q.population, q.protected))
    pixels = {}
    for i, *p in rows:
        pixels.setdefault(i, []).append((*p[:4], bool(flat) and p[4]))
    assert got == {i: derived(p, target, floor) for i, p in pixels.items()}


def test_no_call_for_each_image(spark):
    px = spark.createDataFrame(images(1), PIXEL)
    plan = image.derive_clusters(px, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
