"""Ink beside ink, strokes, pens and distortions, on stacks of masks or of ink maps (n x height x width, ink 1, paper 0).

A sign and its letter are two stacks on one canvas: the sign is pasted before it is measured. A measure that has
nothing to measure gives NaN, a room of 0, a false predicate; nothing here fails on empty ink.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.operators import images

# Ink of faint strokes and of strokes, pixels of a faint stroke; share of the fullest column that a
# sign's body has; least change of a pen that is drawn.
LOW, HIGH, LEAST_FAINT = 0.2, 0.5, 3
BODY = 0.35
LEAST_CHANGE = 0.25

# Degrees, slope, stretches and shift; elastic pixels; chances and sizes of the other distortions.
FULL = {
    "rot": 2.0, "shear": 0.2, "scale_x": (0.85, 1.0), "scale_y": (0.85, 1.1), "shift_y": 0.05, "elastic": 1.5, "p_elastic": 0.5, "p_thick": 0.15, "p_thin": 0.1,
    "p_blur": 0.25, "blur": (0.5, 1.2), "ink": (0.55, 1.0), "p_shade": 0.5, "shade": (0.05, 0.3), "p_lines": 0.15, "lines": (0.2, 0.55), "p_noise": 0.5, "noise": (0.01, 0.06),
}
LIGHT = {**FULL, "rot": 1.0, "shear": 0.1, "elastic": 0.8, "p_blur": 0.1, "ink": (0.8, 1.0), "p_shade": 0.2, "p_lines": 0.05, "p_noise": 0.3}
PRESETS = {"full": FULL, "light": LIGHT, "none": None}


# ---------------------------------------------------------------- ink beside ink


def ends(masks: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last set place along an axis; past the end and -1 where none is set."""
    side, some = masks.shape[axis], masks.any(axis)
    return np.where(some, masks.argmax(axis), side), np.where(some, side - 1 - np.flip(masks, axis).argmax(axis), -1)


def distances(masks: np.ndarray) -> np.ndarray:
    """Distance from each pixel to the nearest set one: along rows first, then over the rows; infinite if none is set."""
    h, w = masks.shape[1:]
    x, y = np.arange(w), np.arange(h)
    left = np.maximum.accumulate(np.where(masks, x, -np.inf), axis=2)
    right = np.minimum.accumulate(np.where(masks, x, np.inf)[..., ::-1], axis=2)[..., ::-1]
    along = np.minimum(x - left, right - x) ** 2
    out = np.full(masks.shape, np.inf)
    for k in range(h):
        np.minimum(out, along[:, k : k + 1] + ((y - k) ** 2)[:, None], out=out)
    return np.sqrt(out)


def room(canvas: np.ndarray, sign: np.ndarray, reach: int) -> np.ndarray:
    """Pixels that the sign can move left until it touches ink at most ``reach`` pixels away in one of its rows; 0 if there is none."""
    first = ends(sign, 2)[0]
    x = np.arange(canvas.shape[2])
    last = ends(canvas & (x < first[..., None]) & (x >= first[..., None] - reach - 1), 2)[1]
    gap = np.where((last >= 0) & sign.any(2), first - last - 1, canvas.shape[2])
    return np.where((gap < canvas.shape[2]).any(1), gap.min(1), 0)


def overhang(canvas: np.ndarray, sign: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """How far the sign reaches left past the last ink of its rows, at most; the canvas counts from ``begin`` to ``end``."""
    seen = canvas.copy()
    seen[:, :, :begin] = False
    if end is not None:
        seen[:, :, end:] = False
    both = seen.any(2) & sign.any(2)
    past = np.where(both, ends(seen, 2)[1] - ends(sign, 2)[0] + 1.0, -np.inf).max(1)
    return np.where(both.any(1), past, np.nan)


def enclosed(canvas: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Whether a pixel of the sign has ink above and below it in its column."""
    top, bottom = ends(canvas, 1)
    y = np.arange(canvas.shape[1])[:, None]
    return (sign & (top[:, None] < y) & (y < bottom[:, None])).any((1, 2))


def nested(letter: np.ndarray, sign: np.ndarray, above: bool, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Whether the sign sits in a hollow of its letter or on it.

    The letter's ink lies in a column of the sign between the side of the sign's frame (rows ``begin`` to ``end``) that
    is away from the letter and the sign's ink next to it, or left and right of the sign in one of its rows.
    """
    y = np.arange(letter.shape[1])[:, None]
    first, last = (e[:, None] for e in ends(sign, 1))
    side = letter.shape[1] if end is None else end
    zone = (y >= begin) & (y <= last) if above else (y < side) & (y >= first)
    column = (letter & zone & sign.any(1)[:, None]).any((1, 2))
    (a, b), (c, d) = ends(letter, 2), ends(sign, 2)
    return column | (sign.any(2) & (a < c) & (b > d)).any(1)


def apart(canvas: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Pixels between the sign and the nearest ink in any direction: 0 if they touch, -1 if they overlap."""
    near = np.where(sign, distances(canvas), np.inf).min((1, 2)) - 1
    return np.where(np.isfinite(near), near, np.nan)


def body(masks: np.ndarray, share: float = BODY) -> np.ndarray:
    """The sign without its lead-in: nothing left of the first column that has ``share`` of the fullest column's ink."""
    column = masks.sum(1)
    begin = (column >= share * column.max(1, keepdims=True)).argmax(1)
    return masks & (np.arange(masks.shape[2]) >= begin[:, None, None])


def fit(pairs: np.ndarray, shift: int, reach: int) -> list:
    """Measures of signs pasted ``shift`` columns right on their letters, for images of a letter over its sign."""
    h, w = pairs.shape[1] // 2, pairs.shape[2]
    canvas, sign = np.zeros((2, len(pairs), h, w + shift), bool)
    canvas[:, :, :w] = images._dark(pairs[:, :h])
    sign[:, :, shift:] = images._dark(pairs[:, h:])
    told = [room(canvas, sign, reach), overhang(canvas, sign), enclosed(canvas, sign), nested(canvas, sign, True), apart(canvas, sign), body(sign).sum((1, 2))]
    return [t.astype(int) if t.dtype == bool else t for t in told]


def fit_of(shift: int, reach: int):
    """Column expression of ``fit``, for a column of images of a letter over its sign, both of one size."""
    return images.measure("room long, overhang double, enclosed long, nested long, apart double, body long", lambda s: fit(s, shift, reach))


# ---------------------------------------------------------------- strokes and pens


def grown(masks: np.ndarray) -> np.ndarray:
    """The masks and what touches them with a side."""
    out = masks.copy()
    out[:, 1:] |= masks[:, :-1]
    out[:, :-1] |= masks[:, 1:]
    out[:, :, 1:] |= masks[:, :, :-1]
    out[:, :, :-1] |= masks[:, :, 1:]
    return out


def stroke_masks(ink: np.ndarray) -> np.ndarray:
    """Strokes of ink maps, with the faint pieces that come within two pixels of one; neither specks nor the soft rim of a stroke."""
    strong, visible = ink > HIGH, ink > LOW
    rim = grown(strong) & ~strong
    root = images.pieces(visible & ~strong & ~rim)
    inside = root >= 0
    keep = np.bincount(root[inside], minlength=root.size) >= LEAST_FAINT
    close = np.zeros(root.size, bool)
    close[root[inside & grown(grown(strong))]] = True
    faint = inside & (keep & close)[root]
    return strong | faint | rim & visible & grown(faint)


def stroke_widths(masks: np.ndarray) -> np.ndarray:
    """Twice the ink over its outline; 0 without ink."""
    return 2.0 * masks.sum((1, 2)) / np.maximum(images.outline(masks), 1)


def redrawn(ink: np.ndarray, pen: float) -> list[tuple[np.ndarray, int]]:
    """Each ink map with strokes of about ``pen`` pixels, at least one, and the border it has gained on each side.

    A map whose strokes hardly change, or that has fewer than three pixels of them, is returned as it is.
    """
    masks = stroke_masks(ink)
    have = stroke_widths(masks)
    change = np.maximum(pen - have, 1 - have) / 2
    as_is = (masks.sum((1, 2)) < 3) | (np.abs(change) < LEAST_CHANGE)
    border = np.ceil(np.maximum(change, 0)).astype(int) + 1
    frame = int(border.max(initial=0))
    wide = np.pad(masks, ((0, 0), (frame, frame), (frame, frame)))
    edge = np.where(wide, distances(~wide) - 0.5, 0.5 - distances(wide))
    drawn = np.clip(edge + change[:, None, None] + 0.5, 0, 1).astype(np.float32)
    out = []
    for k, b in enumerate(border):
        cut = slice(frame - b, -(frame - b) or None)
        out.append((ink[k], 0) if as_is[k] else (drawn[k][cut, cut], int(b)))
    return out


def soft_ink(stack: np.ndarray) -> np.ndarray:
    return images.mapped(stack, images.style(stack)[0])


def _pen(stack: np.ndarray, pen: float) -> list:
    ink = soft_ink(stack)
    masks = stroke_masks(ink)
    drawn = redrawn(ink, pen)
    widths = [float(stroke_widths(d[None] > HIGH)[0]) for d, _ in drawn]
    return [masks.sum((1, 2)), (masks & (ink <= HIGH)).sum((1, 2)), stroke_widths(masks), widths, [b for _, b in drawn]]


def pen_of(pen: float):
    """Column expression: pixels of the strokes, faint ones among them, stroke width, width once redrawn, border gained."""
    return images.measure("pixels long, faint long, width double, redrawn double, border long", lambda s: _pen(s, pen))


# ---------------------------------------------------------------- distortions


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, by the four around; paper outside. Pixel centres are at halves."""
    frame = np.pad(image, 1)
    x, y = (np.clip(v + 0.5, 0, side + 0.999) for v, side in ((x, image.shape[1]), (y, image.shape[0])))
    i, j = y.astype(int), x.astype(int)
    down, right = y - i, x - j
    above = frame[i, j] * (1 - right) + frame[i, j + 1] * right
    below = frame[i + 1, j] * (1 - right) + frame[i + 1, j + 1] * right
    return above * (1 - down) + below * down


def _smooth(grid: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return images.resampling(grid.shape[0], shape[0]) @ grid @ images.resampling(grid.shape[1], shape[1]).T


def distorted(image: np.ndarray, random: np.random.Generator, how: dict | None = FULL) -> np.ndarray:
    """An ink map as another hand, pen, paper and camera would give it; the same for the same generator. Without ``how`` as it is."""
    if how is None or not image.size:
        return image
    h, w = image.shape

    def some(name: str) -> float:
        return random.uniform(*how[name])

    def happens(name: str) -> bool:
        return bool(random.random() < how[name])

    turn, slope = np.radians(random.uniform(-how["rot"], how["rot"])), random.uniform(-how["shear"], how["shear"])
    forward = np.array([[some("scale_x"), slope], [0, some("scale_y")]]) @ np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
    back = np.linalg.inv(forward)
    centre = np.array([w / 2, h / 2])
    to = np.stack(np.meshgrid(np.arange(w) + 0.5, np.arange(h) + 0.5)).reshape(2, -1) - centre[:, None]
    to[1] -= random.uniform(-how["shift_y"], how["shift_y"]) * h
    x, y = (back @ to + centre[:, None]).reshape(2, h, w)
    if happens("p_elastic"):
        x, y = (v + _smooth(random.normal(0, how["elastic"], (3, max(w // 32, 2))), (h, w)) for v in (x, y))
    out = _sampled(image, x, y)
    pick = random.random()
    if pick < how["p_thick"] + how["p_thin"]:
        thick = pick < how["p_thick"]
        around = np.lib.stride_tricks.sliding_window_view(np.pad(out, 1, constant_values=0.0 if thick else 1.0), (3, 3))
        out = around.max((2, 3)) if thick else around.min((2, 3))
    if happens("p_blur"):
        bell = np.exp(-(np.arange(-3, 4) ** 2) / (2 * some("blur") ** 2))
        for axis in (1, 0):
            edge = [(3, 3) if k == axis else (0, 0) for k in (0, 1)]
            out = np.lib.stride_tricks.sliding_window_view(np.pad(out, edge, mode="edge"), 7, axis=axis) @ (bell / bell.sum())
    out = out * some("ink")
    if happens("p_shade"):
        out = out + (1 - out) * some("shade") * _smooth(random.random((3, max(w // 48, 2))), (h, w))
    if happens("p_lines"):
        line = random.uniform(0.55, 0.95) * h + random.uniform(-0.01, 0.01) * np.arange(w)
        out = np.maximum(out, some("lines") * (1.5 - np.abs(np.arange(h)[:, None] - line)).clip(0, 1))
    if happens("p_noise"):
        out = out + random.normal(0, some("noise"), out.shape)
    return out.clip(0, 1)


def distorted_of(image: str, key: Column, seed: int, preset: str = "full") -> Column:
    """Images of the soft ink, distorted, as rows of pixels with dark ink. Each row's key and the seed fix its distortion, so a task that runs again gives the same; null for bad images."""
    how = PRESETS[preset]

    @F.pandas_udf("array<array<int>>")
    def run(pixels: pd.Series, height: pd.Series, keys: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(pixels), dtype=object)
        for k, (p, h, key) in enumerate(zip(pixels, height, keys, strict=True)):
            if p is not None:
                stack = np.asarray(p).clip(0, 255).astype(np.uint8).reshape(1, int(h), -1)
                done = distorted(soft_ink(stack)[0], np.random.default_rng([seed, int(key) & (1 << 64) - 1]), how)
                out[k] = np.round(255 * (1 - done)).astype(int).tolist()
        return out

    i = F.col(image)
    return run(F.when(images.even(i), F.flatten(i)), F.when(images.even(i), F.size(i)), F.coalesce(key.cast("long"), F.lit(0)))
