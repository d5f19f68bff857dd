"""Spacing of writing from the boxes of its pieces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: A wider gap, in letter heights, parts words.
WORD_GAP = 1.5
SCHEMA = "page long, letter_height double, letters long, lines long, single_width double, gaps long, median_gap double, joined long, touching double"


def height_of_letters(heights: np.ndarray) -> float:
    """The median of the taller half."""
    return float(np.median(np.sort(heights)[len(heights) // 2 :]))


def line_of(middles: np.ndarray, within: float) -> np.ndarray:
    """The line of each box, from the top: it joins the first line whose first box is within reach, else it opens one."""
    heads: list[float] = []
    out = np.empty(len(middles), int)
    for i in np.argsort(middles, kind="stable"):
        near = np.flatnonzero(np.abs(np.array(heads) - middles[i]) < within)
        if not len(near):
            heads.append(middles[i])
        out[i] = near[0] if len(near) else len(heads) - 1
    return out


def measured(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple:
    """Letter height, letters, lines, width of a single letter, visible gaps, their median, joined letters, share that touch."""
    unit = height_of_letters(y1 - y0)
    own = (y1 - y0) >= 0.6 * unit
    x0, x1, middle = x0[own], x1[own], (y0[own] + y1[own]) / 2
    line = line_of(middle, 0.5 * unit)
    order = np.lexsort((x0, line))
    gap = (x0[order][1:] - x1[order][:-1]) / unit
    gap = gap[(line[order][1:] == line[order][:-1]) & (gap <= WORD_GAP)]
    width = (x1 - x0) / unit
    narrow = width[width < 1.5]
    single = float(np.median(narrow)) if len(narrow) else None
    joined = int((np.maximum(np.round(width / single), 1) - 1).sum()) if single else 0
    return unit, len(x0), int(line.max()) + 1, single, len(gap), float(np.median(gap)) if len(gap) else None, joined, joined / max(joined + len(gap), 1)


def spacing(boxes: DataFrame) -> DataFrame:
    """One row a page of boxes (page, x0, y0, x1, y1). Lines are found in order, so a page, a bounded thing, is measured whole."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        told = measured(*(pdf[c].to_numpy(float) for c in ("x0", "x1", "y0", "y1")))
        return pd.DataFrame([(pdf["page"].iloc[0], *told)], columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return boxes.select("page", "x0", "y0", "x1", "y1").dropna().groupBy("page").applyInPandas(run, SCHEMA)
