"""Ink beside ink, strokes, pens and distortions against loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.operators import ink

RNG = np.random.default_rng(11)


def spots(mask):
    return [tuple(p) for p in np.argwhere(mask).tolist()]


@pytest.mark.parametrize("share", [0.0, 0.08, 0.3, 0.7])
def test_signs_against_loops(share):
    canvas, sign = RNG.random((2, 60, 7, 12)) < share
    room, hang, inside, apart = ink.room(canvas, sign, 3), ink.overhang(canvas, sign, 2, 11), ink.enclosed(canvas, sign), ink.apart(canvas, sign)
    above, below = ink.nested(canvas, sign, True, 1), ink.nested(canvas, sign, False, 0, 6)
    for k in range(60):
        c, s = spots(canvas[k]), spots(sign[k])
        first = {y: min(x for v, x in s if v == y) for y, _ in s}
        last = {y: max(x for v, x in s if v == y) for y, _ in s}
        gaps = [first[y] - x - 1 for y, x in c if y in first and first[y] - 4 <= x < first[y]]
        assert room[k] == min(gaps, default=0)
        past = [max(x for v, x in c if v == y and 2 <= x < 11) - first[y] + 1 for y in first if any(v == y and 2 <= x < 11 for v, x in c)]
        assert hang[k] == max(past) if past else math.isnan(hang[k])
        assert inside[k] == any((u, x) in c and (v, x) in c for y, x in s for u in range(y) for v in range(y + 1, 7))
        cup = any(any(v == y and x < first[y] for v, x in c) and any(v == y and x > last[y] for v, x in c) for y in first)
        assert above[k] == (cup or any(1 <= y and any(x == u and y <= v for v, u in s) for y, x in c))
        assert below[k] == (cup or any(y < 6 and any(x == u and y >= v for v, u in s) for y, x in c))
        want = min((math.dist(p, q) for p in c for q in s), default=None)
        assert math.isclose(apart[k], want - 1, abs_tol=1e-12) if want is not None else math.isnan(apart[k])


def test_body_leaves_the_lead_in():
    mask = np.zeros((2, 6, 8), bool)
    mask[0, 5, :6] = True
    mask[0, 1:, 5] = True
    got = ink.body(mask)
    assert got[0].sum() == 5 and not got[0][:, :5].any() and not got[1].any()


def test_faint_strokes_stay_and_specks_go():
    soft = np.zeros((2, 14, 14))
    soft[0, 5:9, 3:7] = 0.9
    soft[0, 5:9, 7] = 0.3  # rim
    soft[0, 6, 8:12] = 0.3  # a faint stroke across the rim
    soft[0, 12, 12] = 0.3  # a speck
    soft[1, 2:5, 2:9] = 0.3  # faint without a stroke
    got = ink.stroke_masks(soft)
    assert got[0, 6, 7:12].all() and not got[0, 12, 12] and not got[0, 5, 7] and got[0].sum() == 16 + 4 + 1 and not got[1].any()


@pytest.mark.parametrize("pen", [1.0, 3.0, 6.0, 9.0])
def test_pens(pen):
    bar = np.zeros((2, 40, 60))
    bar[0, 18:23, 8:52] = 1.0
    (drawn, border), (same, none) = ink.redrawn(bar, pen)
    column = (drawn[:, drawn.shape[1] // 2] > 0.5).sum()
    have = ink.stroke_widths(bar[:1] > 0.5)[0]
    assert drawn.shape == (40 + 2 * border, 60 + 2 * border) and abs(column - (5 + max(pen, 1) - have)) <= 1
    assert none == 0 and np.array_equal(same, bar[1]) and ink.stroke_widths(bar[1:] > 0.5)[0] == 0


def test_distances_against_loops():
    mask = RNG.random((5, 6, 9)) < 0.1
    mask[0] = False
    got = ink.distances(mask)
    for k in range(5):
        for y in range(6):
            for x in range(9):
                assert math.isclose(got[k, y, x], min((math.dist((y, x), p) for p in spots(mask[k])), default=math.inf))


def test_distortions():
    image = np.zeros((32, 48))
    image[10:22, 14:30] = 1.0
    still = {**ink.FULL, "rot": 0, "shear": 0, "scale_x": (1, 1), "scale_y": (1, 1), "shift_y": 0, "ink": (1, 1), **{k: 0 for k in ink.FULL if k.startswith("p_")}}
    assert np.allclose(ink.distorted(image, np.random.default_rng(1), still), image)
    assert np.array_equal(ink.distorted(image, np.random.default_rng(1), None), image)
    thick = ink.distorted(image, np.random.default_rng(1), {**still, "p_thick": 1})
    thin = ink.distorted(image, np.random.default_rng(1), {**still, "p_thin": 1})
    assert thick.sum() == 14 * 18 and thin.sum() == 10 * 14
    moved = ink.distorted(image, np.random.default_rng(1), {**still, "rot": 90.0})
    assert abs(moved.sum() - image.sum()) < 0.1 * image.sum()
    for seed in range(40):
        a, b = (ink.distorted(image, np.random.default_rng(seed), ink.LIGHT) for _ in range(2))
        assert np.array_equal(a, b) and a.min() >= 0 and a.max() <= 1 and a.shape == image.shape


def test_bad_images_give_nulls(spark):
    rows = [(1, [[0, 255], [255, 0]]), (2, None), (3, []), (4, [[1], [1, 2]]), (5, [[1, None]]), (None, [[9, 9]])]
    df = spark.createDataFrame(rows, "k long, gray array<array<int>>")
    got = df.select("k", ink.pen_of(2.0)("gray")["pixels"].alias("p"), ink.distorted_of("gray", F.col("k"), 1).alias("d")).collect()
    assert [r["p"] is None for r in got] == [False, True, True, True, True, False] == [r["d"] is None for r in got]
