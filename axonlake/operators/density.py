"""Density of points over a plane: data-driven bandwidths, the density on a grid, and its basins.

Rows are counted on a grid before anything else (a native aggregate with map-side partial counts), so what reaches one task is bounded by the
grid whatever the number of rows. Rows with a null or NaN coordinate, and null keys, take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = math.sqrt(2 * math.pi)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def _whole(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose keys and values are there; values as doubles."""
    rows = rows.select(*keys, *(F.col(v).cast("double").alias(v) for v in values)).dropna()
    for v in values:
        rows = rows.filter(~F.isnan(v))
    return rows


def _derivative_sum(counts: np.ndarray, step: float, near: float, order: int, g: float) -> float:
    """Sum over ordered pairs of rows at different values of the normal density's derivative of even order at (x - y) / g, from counts of equally
    spaced bins; `near` pairs share a bin and count at distance 0."""
    n = len(counts)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(counts, size)
    lags = np.rint(np.fft.irfft(spectrum * np.conj(spectrum), size)[:n])  # pairs of rows that lie k bins apart
    lags[0] = near / 2
    u = np.arange(n) * step / g
    polynomial = {4: u**4 - 6 * u**2 + 3, 6: u**6 - 15 * u**4 + 45 * u**2 - 15}[order]
    return float(2 * (lags * polynomial * np.exp(-u * u / 2)).sum() / ROOT)


def solve_bandwidth(n: float, sd: float, counts: np.ndarray, step: float, near: float) -> float:
    """The two-stage plug-in bandwidth of a normal kernel (Sheather and Jones 1991; Wand and Jones 1995): the eighth-order functional of a normal
    density gives the pilot width of the sixth, that of the fourth, and that the bandwidth. Functionals are means over pairs of different values.
    If one of them has the wrong sign, as it may in small samples, the normal-scale bandwidth is given."""
    scale = sd * (4 / (3 * n)) ** 0.2
    eighth = 105 / (32 * math.sqrt(math.pi) * sd**9)
    g6 = (30 / (ROOT * eighth * n)) ** (1 / 9)
    sixth = _derivative_sum(counts, step, near, 6, g6) / (n * (n - 1) * g6**7)
    if not sixth < 0:
        return scale
    g4 = (-6 / (ROOT * sixth * n)) ** (1 / 7)
    fourth = _derivative_sum(counts, step, near, 4, g4) / (n * (n - 1) * g4**5)
    return (1 / (2 * math.sqrt(math.pi) * fourth * n)) ** 0.2 if fourth > 0 else scale


def plug_in_bandwidth(rows: DataFrame, keys: list[str], value: str, bins: int = 2048) -> DataFrame:
    """(keys, n, h): plug-in bandwidth of `value` for each key, from counts in `bins` bins over the key's range. h is null for fewer than two rows
    or where all rows are equal."""
    v = _whole(rows, keys, [value]).withColumnRenamed(value, "v")
    facts = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    value_counts = v.groupBy(*keys, "v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    binned = value_counts.join(facts, keys).groupBy(*keys, "n", "lo", "hi", "sd", at.cast("int").alias("b")).agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("equal"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, sd = float(first["n"]), first["sd"]
        h = None
        if n > 1 and first["hi"] > first["lo"] and sd > 0:
            counts = np.zeros(bins)
            counts[pdf["b"].to_numpy()] = pdf["c"].to_numpy()
            near = float((pdf["c"] ** 2 - pdf["equal"]).sum())
            h = solve_bandwidth(n, float(sd), counts, float(first["hi"] - first["lo"]) / bins, near)
        return pd.DataFrame({**{k: [first[k]] for k in keys}, "n": [int(n)], "h": pd.Series([h], dtype="float64")})

    out = binned.groupBy(*keys).applyInPandas(solve, f"{_kinds(rows, keys)}n long, h double")
    return out.withColumn("h", F.when(~F.isnan("h"), F.col("h")))


def mark_basins(density: np.ndarray, depth: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(basin of each cell, peak of each basin as flat index): cells from the densest down join the basin of their densest neighbour of eight
    (ties: the lower index). Where two basins meet, the one of the lower peak joins the other if it rises less than the share `depth` of its peak above
    the meeting point. Basins are numbered from 1 by falling peak; cells under the share `floor` of the highest density are in none (0)."""
    ny = density.shape[1]
    flat = density.ravel()
    order = [int(k) for k in np.lexsort((np.arange(flat.size), -flat)) if flat[k] > 0 and flat[k] >= floor * flat.max()]
    rank = {k: r for r, k in enumerate(order)}
    parent: dict[int, int] = {}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    home: dict[int, int] = {}
    for k in order:
        i, j = divmod(k, ny)
        around = [(i + a) * ny + j + b for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= i + a < density.shape[0] and 0 <= j + b < ny]
        seen = sorted((m for m in around if m in home), key=rank.__getitem__)
        if not seen:
            parent[k] = home[k] = k
            continue
        home[k] = home[seen[0]]
        for m in seen:
            high, low = sorted((root(home[k]), root(home[m])), key=rank.__getitem__)
            if high != low and flat[low] - flat[k] < depth * flat[low]:
                parent[low] = high
    peaks = [k for k in order if home[k] == k and root(k) == k]
    number = {p: r + 1 for r, p in enumerate(peaks)}
    out = np.zeros(flat.size, int)
    for k in order:
        out[k] = number[root(home[k])]
    return out.reshape(density.shape), np.array(peaks, int)


def density_basins(rows: DataFrame, keys: list[str], x: str, y: str, points: int = 48, fine: int = 8, depth: float = 0.0, floor: float = 1e-6, bandwidth: tuple[float, float] | None = None) -> DataFrame:
    """(keys, i, j, x, y, density, peak, basin): density of the rows of each key at `points` x `points` places that span their range, by a
    normal kernel with one bandwidth for each axis (the plug-in one if not given), and the basin of each place (see mark_basins).

    Rows are counted in `fine` cells between two places and stand at the middle of their cell's rows; an axis on which all rows are equal has one place and no kernel. Keys of one
    row give one place with density 1.
    """
    p = _whole(rows, keys, [x, y]).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    facts = p.groupBy(*keys).agg(*(f(c).alias(f"{c}_{name}") for c in "xy" for name, f in (("lo", F.min), ("hi", F.max))))
    if bandwidth is None:
        for c in "xy":
            facts = facts.join(plug_in_bandwidth(p, keys, c).select(*keys, F.col("h").alias(f"{c}_h")), keys)
    else:
        facts = facts.withColumns({"x_h": F.lit(float(bandwidth[0])), "y_h": F.lit(float(bandwidth[1]))})
    last = (points - 1) * fine
    at = {c: F.coalesce(F.round(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")) * last), F.lit(0)).cast("int") for c in "xy"}
    edges = ["x_lo", "x_hi", "x_h", "y_lo", "y_hi", "y_h"]
    cells = p.join(facts, keys).groupBy(*keys, *edges, at["x"].alias("p"), at["y"].alias("q")).agg(F.count(F.lit(1)).cast("double").alias("c"), F.avg("x").alias("x"), F.avg("y").alias("y"))

    def axis(pdf, name):
        """Places of an axis and the kernel between them and the middles of the rows of all cells."""
        lo, hi, h = (pdf[f"{name}_{e}"].iloc[0] for e in ("lo", "hi", "h"))
        if not hi > lo:
            return np.array([lo]), np.ones((1, len(pdf)))
        place = np.linspace(lo, hi, points)
        return place, np.exp(-0.5 * ((place[:, None] - pdf[name].to_numpy()[None, :]) / h) ** 2) / (ROOT * h)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, c = pdf.iloc[0], pdf["c"].to_numpy()
        (px, kx), (py, ky) = axis(pdf, "x"), axis(pdf, "y")
        density = (kx * c) @ ky.T / c.sum()
        basin, peaks = mark_basins(density, depth, floor)
        i, j = (a.ravel() for a in np.indices(density.shape))
        top = np.isin(np.arange(density.size), peaks)
        return pd.DataFrame({**{k: [first[k]] * density.size for k in keys}, "i": i, "j": j, "x": px[i], "y": py[j], "density": density.ravel(), "peak": top, "basin": basin.ravel()})

    return cells.groupBy(*keys).applyInPandas(run, f"{_kinds(rows, keys)}i int, j int, x double, y double, density double, peak boolean, basin int")


def basin_of(rows: DataFrame, basins: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """rows with `basin` of the place of density_basins nearest to them; null where a coordinate or a key is missing, as for places in no basin."""
    g = basins.groupBy(*keys).agg(*(f(c).alias(f"__{c}_{name}") for c in "xy" for name, f in (("lo", F.min), ("hi", F.max))), F.max("i").alias("__x_n"), F.max("j").alias("__y_n"))
    at = {c: F.when(F.col(v).isNotNull(), F.coalesce(F.round(F.try_divide(F.col(v).cast("double") - F.col(f"__{c}_lo"), F.col(f"__{c}_hi") - F.col(f"__{c}_lo")) * F.col(f"__{c}_n")), F.lit(0))).cast("int") for c, v in (("x", x), ("y", y))}
    placed = rows.join(g, keys, "left").withColumns({"__i": at["x"], "__j": at["y"]}).select(*rows.columns, "__i", "__j")
    marks = basins.filter("basin > 0").select(*keys, F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("basin").alias("__basin"))
    return placed.join(marks, [*keys, "__i", "__j"], "left").select(*rows.columns, F.col("__basin").alias("basin"))
