"""Response curves by a kernel of locally adaptive bandwidth.

Offsets of events from their stimuli are reduced natively to at most one row per grid cell (or per distinct offset, where these are fewer), so
a (recording, pattern, channel) is a row with a bounded array however many events it has. The widths are then found on that row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stimulus import offset_cells

ROOT_2PI = math.sqrt(2 * math.pi)
GOLDEN = (math.sqrt(5) - 1) / 2


def width_candidates(step: float, span: float, count: int) -> np.ndarray:
    """Widths from five grid steps to the whole span, evenly spaced under the inverse of log(1 + exp)."""
    low, high = (x if x > 100 else math.log(math.expm1(x)) for x in (5 * step, span))
    return np.logaddexp(0, np.linspace(low, high, count))


def smooth(rows: np.ndarray, width: float) -> np.ndarray:
    """Each row convolved with a Gaussian of `width` grid steps, through the frequency domain with room for three widths."""
    length = rows.shape[-1]
    n = 1 << max(1, math.ceil(math.log2(length + 3 * width)))
    gain = np.exp(-2 * (np.pi * width * np.fft.rfftfreq(n)) ** 2)
    return np.fft.irfft(np.fft.rfft(rows, n) * gain, n)[..., :length]


def _cost(rate: np.ndarray, histogram: np.ndarray, width) -> np.ndarray:
    """Estimated integrated squared error of `rate`, but for a term that does not depend on it."""
    return rate * (rate - 2 * histogram) + 2 / (ROOT_2PI * width) * histogram


def best_local_widths(histogram: np.ndarray, widths: np.ndarray, step: float) -> np.ndarray:
    """(windows, grid): for each window size (the same list as the widths) the width of least cost around each grid point."""
    costs = np.stack([_cost(smooth(histogram, w / step), histogram, w) for w in widths])
    return np.stack([widths[smooth(costs, window / step).argmin(axis=0)] for window in widths])


class StiffnessCurve:
    """Rate and widths as a function of the stiffness: the ratio of a kernel's width to the window that it was chosen in."""

    def __init__(self, histogram: np.ndarray, grid: np.ndarray, widths: np.ndarray, local: np.ndarray):
        self.histogram, self.grid, self.widths, self.step = histogram, grid, widths, float(np.diff(grid).min())
        self.ratio = local / widths[:, None]
        self.apart = grid[:, None] - grid[None, :]
        self.full = np.flatnonzero(histogram)

    def __call__(self, stiffness: float) -> tuple[float, np.ndarray, np.ndarray]:
        """(total cost, density that sums to the number of events, width at each grid point)."""
        reach = self.ratio >= stiffness
        largest = len(self.widths) - 1 - reach[::-1].argmax(axis=0)
        chosen = stiffness * self.widths[largest]
        chosen = np.where(reach.any(axis=0), np.where(stiffness < self.ratio.min(axis=0), self.widths[-1], chosen), self.widths[0])
        wide = chosen / stiffness
        share = np.exp(-0.5 * (self.apart / wide) ** 2) / wide
        width = (share @ chosen) / share.sum(axis=1)
        near = np.exp(-0.5 * (self.apart[:, self.full] / width[:, None]) ** 2) / (ROOT_2PI * width[:, None])
        rate = near @ self.histogram[self.full]
        rate *= self.histogram.sum() / rate.sum()
        return float(_cost(rate, self.histogram, width).sum() * self.step), rate, width


def golden_section(f, low: float, high: float, tolerance: float = 1e-5, most: int = 30):
    """The f(x) of least first element found by golden-section search."""
    a, b = high - GOLDEN * (high - low), low + GOLDEN * (high - low)
    at_a, at_b = f(a), f(b)
    for _ in range(most):
        if abs(high - low) <= tolerance * (abs(a) + abs(b)):
            break
        if at_a[0] < at_b[0]:
            high, b, at_b = b, a, at_a
            a = high - GOLDEN * (high - low)
            at_a = f(a)
        else:
            low, a, at_a = a, b, at_b
            b = low + GOLDEN * (high - low)
            at_b = f(b)
    return min(at_a, at_b, key=lambda r: r[0])


def adaptive_density(offsets: np.ndarray, counts: np.ndarray, grid: np.ndarray, exact: bool = True, widths: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """(density, width) at the grid points, from distinct ascending offsets with their counts; the density integrates to 1.

    Where the offsets are exact and further apart than a grid step, they are counted on a coarser grid of that distance (if it has at least
    8 points) and the curves are interpolated. A cell reaches half a step to either side of its point; the last point's cell is left out.
    """
    span = float(grid[-1] - grid[0])
    gap = float(np.diff(offsets).min()) if exact and len(offsets) > 1 else 0.0
    own = grid
    if gap > np.diff(grid).min() and 8 <= (n := min(math.ceil(span / gap), 1000)):
        own = np.linspace(grid[0], grid[-1], n)
    step = float(np.diff(own).min())
    cell = np.floor((offsets - own[0]) / step + 0.5).astype(int)
    keep = (cell >= 0) & (cell < len(own) - 1)
    histogram = np.bincount(cell[keep], weights=counts[keep], minlength=len(own)) / step
    if not histogram.any():
        return np.zeros(len(grid)), np.full(len(grid), span)
    w = width_candidates(step, span, widths)
    _, rate, width = golden_section(StiffnessCurve(histogram, own, w, best_local_widths(histogram, w, step)), 1e-12, 1.0)
    density = rate / (rate.sum() * step)
    return np.interp(grid, own, density), np.interp(grid, own, width)


def adaptive_response(spikes: DataFrame, stim: DataFrame, w0: float, w1: float, points: int = 1000, widths: int = 80) -> DataFrame:
    """(rec, pattern, ch, i, t, rate, width): events per second and trial on a grid of `points` from w0 to w1 seconds around the stimuli, by a
    Gaussian kernel whose width is chosen at each point, and that width.

    Local costs over `widths` widths choose a width for every window size, and a golden-section search the stiffness. Channels without events in
    the window have no rows.
    """
    if points < 8 or not w0 < w1:
        raise ValueError("points must be at least 8 and w0 below w1")
    by, step = ["rec", "pattern", "ch"], (w1 - w0) / (points - 1)
    exact, w = F.col("x").isNotNull(), Window.partitionBy(*by)
    cells = offset_cells(spikes, stim, w0, w1, points, most=points + 1).select(*by, F.coalesce("x", w0 + F.col("i") * step).alias("x"), "n", F.sum("n").over(w).alias("events"), exact.alias("exact"))
    rows = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("cells"), F.first("events").alias("events"), F.first("exact").alias("exact"))
    trials = stim.groupBy("rec", "pattern").agg(F.count(F.lit(1)).alias("trials"))
    grid = np.linspace(w0, w1, points)

    @F.pandas_udf("array<struct<density double, width double>>")
    def curve(cells: pd.Series, exact: pd.Series) -> pd.Series:
        out = []
        for c, e in zip(cells, exact):
            x, n = np.array([v["x"] for v in c], float), np.array([v["n"] for v in c], float)
            out.append([{"density": float(a), "width": float(b)} for a, b in zip(*adaptive_density(x, n, grid, bool(e), widths))])
        return pd.Series(out)

    curves = rows.join(trials, ["rec", "pattern"]).select(*by, (F.col("events") / F.col("trials")).alias("scale"), F.posexplode(curve("cells", "exact")).alias("i", "c"))
    return curves.select(*by, "i", (w0 + F.col("i") * step).alias("t"), (F.col("c.density") * F.col("scale")).alias("rate"), F.col("c.width").alias("width"))
