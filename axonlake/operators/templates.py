"""Spike templates: shape features or principal loadings of aligned waveforms, clusters of them by density, and each cluster's median waveform.

waves rows have the keys (such as rec, ch) and `waveform`, arrays of one length with the peak at a fixed place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iterate import cut
from .density import _kinds, basin_of, density_basins

#: Keys whose sums one task holds before it passes them on.
HELD = 256


def _value(i: Column | int) -> Column:
    return F.get(F.col("waveform"), i if isinstance(i, Column) else F.lit(i))


def shape_features(waves: DataFrame, fs: float, peak: int = 25) -> DataFrame:
    """waves with amplitude (value at the peak), width (seconds between the samples next to the peak on both sides that are above half of the
    amplitude; null if there is none) and asymmetry (sum of absolute differences between samples as far before as after the peak)."""
    n = F.size("waveform")
    half = _value(peak) / 2
    above = lambda places: F.filter(places, lambda i: _value(i) > half)
    before = F.array_max(above(F.sequence(F.lit(0), F.lit(peak - 1)))) if peak else F.lit(None).cast("int")
    after = F.array_min(above(F.when(n > peak + 1, F.sequence(F.lit(peak + 1), n - 1))))
    reach = F.least(F.lit(peak), n - 1 - peak)
    apart = F.when(reach > 0, F.transform(F.sequence(F.lit(1), reach), lambda k: F.abs(_value(F.lit(peak) - k) - _value(F.lit(peak) + k))))
    total = F.coalesce(F.aggregate(apart, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    return waves.withColumns({"amplitude": _value(peak), "width": (after - before) / fs, "asymmetry": total})


def _centred() -> Column:
    """The waveform less its own mean."""
    mean = F.aggregate("waveform", F.lit(0.0), lambda a, v: a + v) / F.size("waveform")
    return F.transform("waveform", lambda v: v - mean)


def principal_axes(waves: DataFrame, keys: list[str], components: int = 2) -> DataFrame:
    """(keys, component, axis, size, share): the strongest directions of the waveforms less their own means, one row each, with the singular
    value `size` and the share of the sum of squares. Signs: the largest entry of an axis is positive. Tasks add up products of samples before the
    shuffle, so a channel of many spikes costs one matrix a task. Directions without any size are left out; so are incomplete waveforms."""
    whole = waves.filter(F.col("waveform").isNotNull() & ~F.exists("waveform", lambda v: v.isNull() | F.isnan(v)))
    x = whole.select(*keys, _centred().alias("x"))

    def products(frames):
        held: dict = {}

        def passed():
            for key, m in held.items():
                yield pd.DataFrame({**{k: [v] * m.size for k, v in zip(keys, key)}, "k": np.arange(m.size), "v": m.ravel()})
            held.clear()

        for pdf in frames:
            for key, part in pdf.groupby(keys, dropna=False):
                m = np.stack(part["x"].to_numpy())
                held[key] = held[key] + m.T @ m if key in held else m.T @ m
            if len(held) > HELD:
                yield from passed()
        yield from passed()

    sums = x.mapInPandas(products, f"{_kinds(waves, keys)}k int, v double").groupBy(*keys, "k").agg(F.sum("v").alias("v"))

    def axes(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(round(len(pdf) ** 0.5))
        val, vec = np.linalg.eigh(pdf.sort_values("k")["v"].to_numpy().reshape(p, p))
        val, vec = np.maximum(val[::-1], 0), vec[:, ::-1]
        used = [c for c in range(min(components, p)) if val[c] > 1e-12 * val[0]] or [0]
        sign = np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(p)])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(used) for k in keys}, "component": [c + 1 for c in used], "axis": pd.Series([list(vec[:, c] * sign[c]) for c in used], dtype=object), "size": [float(val[c] ** 0.5) for c in used], "share": pd.Series([float(val[c] / val.sum()) if val[c] else None for c in used], dtype="float64")})

    return sums.groupBy(*keys).applyInPandas(axes, f"{_kinds(waves, keys)}component int, axis array<double>, size double, share double").filter("size > 0")


def loadings(waves: DataFrame, keys: list[str], axes: DataFrame) -> DataFrame:
    """waves with load_1, load_2: each waveform's entry in the first two singular vectors over the spikes of its key; 0 on a direction without size."""
    a = axes.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("component", F.struct("axis", "size")))).alias("__a"))
    dot = lambda c: F.aggregate(F.zip_with(_centred(), F.col("__a")[c]["axis"], lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) / F.col("__a")[c]["size"]
    out = waves.join(a, keys, "left").withColumns({f"load_{c}": F.when(F.col("__a")[c].isNotNull(), dot(c)).otherwise(0.0) for c in (1, 2)})
    return out.drop("__a")


def spike_clusters(waves: DataFrame, keys: list[str], method: str, fs: float, peak: int = 25, depth: float = 0.5, points: int = 48) -> DataFrame:
    """waves with their features and `template`, the number of their cluster: a basin of the density of two features that stands at least the share
    `depth` above its surroundings, numbered from the densest. method: `pca` (load_1, load_2) or `shape` (amplitude, width). Waveforms in no
    basin, or without a width, have template null."""
    if method not in ("pca", "shape"):
        raise ValueError(f"unknown method {method}")
    x, y = ("load_1", "load_2") if method == "pca" else ("amplitude", "width")
    f = loadings(waves, keys, principal_axes(waves, keys)) if method == "pca" else shape_features(waves, fs, peak)
    f = cut(f)  # the bandwidths, the counts and the look-up read it
    return basin_of(f, density_basins(f, keys, x, y, points=points, depth=depth), keys, x, y).withColumnRenamed("basin", "template")


def spike_templates(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, template, i, v, n): median waveform and number of waveforms of every cluster; waveforms in none are left out."""
    w = clusters.filter("template is not null").select(*keys, "template", F.posexplode("waveform").alias("i", "v"))
    return w.groupBy(*keys, "template", "i").agg(F.percentile("v", F.lit(0.5)).alias("v"), F.count("v").alias("n"))
