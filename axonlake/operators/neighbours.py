"""Exact nearest neighbours, and classification by them, without pairs of rows in the plan.

Rows go to the nearest of a bounded number of pivots, and a pivot's rows to chunks by their distance from it, of bounded size whatever the skew.
A first look inside each chunk bounds how far its rows' neighbours can be (their reach). Chunks are then dealt to tiles of some ten thousands
of rows that stay in a task while the rows to compare stream past, so that a row is sent once for each tile and not once for each chunk.
By the triangle inequality a row's neighbours in a pivot's cell have distances to that pivot that meet the row's own, give or take its
reach, so only chunks that some row of a tile asks for are sent to it, and only rows that ask for a batch meet it. Products of matrices
find what may lie within the reach, and exact distances decide.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.iterate import cut

RINGS = 10
BLOCK = 1024  # rows a side that meet at once


def _exact(x, y) -> np.ndarray:
    """Squared distances of rows of x and y, one by one."""
    return ((y - x) ** 2).sum(axis=1)


def _meet(ids, fold, x, within, oid, ofold, y, k: int, folds: bool):
    """(places, ids, squared distances) of the at most k nearest allowed rows of y for each row of x, equal ones by id. within: squared
    distance beyond which a row needs none, infinite for no bound."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    one = np.ones(len(x)), np.ones(len(y))
    near = np.column_stack([-2 * x, xx, one[0]]) @ np.column_stack([y, one[1], yy]).T
    room = 1e-12 * (1 + xx + yy.max())  # against rounding
    limit = within
    if np.isinf(within).any() and len(y) > k:
        near[ofold[None] == fold[:, None] if folds else oid[None] == ids[:, None]] = np.inf
        limit = np.minimum(within, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * room)
    i, j = np.nonzero(near <= (limit + room)[:, None])
    keep = ofold[j] != fold[i] if folds else oid[j] != ids[i]
    i, j = i[keep], j[keep]
    ends = np.searchsorted(i, np.arange(len(x) + 1))
    many = np.diff(ends) > 64 * k  # copies: row by row
    out = []
    few = ~many[i]
    all_j, i, j = j, i[few], j[few]
    if len(i):
        square = _exact(x[i], y[j])
        order = np.lexsort((oid[j], square, i))
        i, j, square = i[order], j[order], square[order]
        start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        top = np.arange(len(i)) - np.repeat(start, np.diff([*start, len(i)])) < k
        out.append((i[top], oid[j][top], square[top]))
    for i in np.flatnonzero(many):
        j = all_j[ends[i] : ends[i + 1]]
        square = _exact(x[i], y[j])
        if len(j) > k:
            best = square <= np.partition(square, k - 1)[k - 1]
            j, square = j[best], square[best]
        top = np.lexsort((oid[j], square))[:k]
        out.append((np.full(len(top), i), oid[j][top], square[top]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def nearest_neighbours(rows: DataFrame, features: list[str], k: int = 1, id_col: str = "id", fold_col: str | None = None, pivots: int = 32, chunk: int = 1000, tile: int = 32768) -> DataFrame:
    """(id, rank, neighbour, distance): the k rows at the least Euclidean distance, equal distances by ascending id. With a fold column neighbours
    are rows of other folds, else all rows of another id.

    Ids are whole numbers; rows with a null id or feature go. A row has fewer than k neighbours only if there are fewer allowed rows.
    """
    if min(k, pivots, chunk, tile) < 1:
        raise ValueError("k, pivots, chunk and tile must be at least 1")
    ok = rows.dropna(subset=[id_col, *features, *([fold_col] if fold_col else [])])
    base = ok.select(F.col(id_col).cast("long").alias("id"), (F.col(fold_col) if fold_col else F.lit(0)).cast("long").alias("fold"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
    posts = np.array([r.x for r in base.select("x").orderBy(F.xxhash64("x")).limit(pivots).collect()], float).reshape(-1, len(features))
    folds, dims = fold_col is not None, len(features)

    @F.pandas_udf("struct<cell int, d double>")
    def place(x: pd.Series) -> pd.DataFrame:
        d = np.stack([np.sqrt(((posts - np.asarray(v, float)) ** 2).sum(axis=1)) for v in x]) if len(x) else np.zeros((0, max(1, len(posts))))
        return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "d": d.min(axis=1)})

    placed = cut(base.withColumn("at", place("x")).select("id", "fold", "x", "at.cell", "at.d"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 1000).alias("rings"))
    parts = F.least(F.lit(RINGS), F.ceil(F.col("n") / chunk))  # rings of a small pivot are not worth a chunk each
    dealt = placed.join(cells, "cell").withColumn("ring", F.floor(F.size(F.filter("rings", lambda r: r < F.col("d"))) * parts / RINGS))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (parts * chunk))))
    n = placed.count()
    tiles = max(1, -(-n // tile))
    splits = max(1, min(-(-24 // tiles), n // 500))  # of what streams past a tile, so that few tiles are work for many tasks
    dealt = dealt.select("id", "fold", "x", "cell", "d", F.struct("cell", "ring", "salt").alias("chunk"), F.pmod(F.xxhash64("cell", "ring", "salt"), F.lit(tiles)).alias("tile"))

    def look(pdf):
        """The rows of a chunk with their reach, and the stretches of distances to each pivot that they ask for."""
        x = np.stack(pdf["x"].to_list()).astype(float)
        ids, fold, reach = pdf["id"].to_numpy(), pdf["fold"].to_numpy(), np.full(len(x), np.inf)
        for at in range(0, len(x), BLOCK):
            part = slice(at, at + BLOCK)
            best = [[] for _ in x[part]]
            for to in range(0, len(x), BLOCK):
                other = slice(to, to + BLOCK)
                for i, s in zip(*_meet(ids[part], fold[part], x[part], np.full(len(x[part]), np.inf), ids[other], fold[other], x[other], k, folds)[::2]):
                    best[i].append(s)
            reach[part] = [sorted(b)[k - 1] if len(b) >= k else np.inf for b in best]
        d = np.sqrt(np.stack([_exact(p, x) for p in posts], axis=1))
        far, room = np.sqrt(reach)[:, None], 1e-9 * (1 + d)
        lo, hi = (d - far - room).min(axis=0), (d + far + room).max(axis=0)
        return pdf.assign(reach=reach, lo=[lo] * len(x), hi=[hi] * len(x))[["id", "fold", "x", "cell", "d", "chunk", "tile", "reach", "lo", "hi"]]

    flat = dealt.select("id", "fold", "x", "cell", "d", F.to_json("chunk").alias("chunk"), "tile")
    looked = cut(flat.groupBy("chunk").applyInPandas(look, "id long, fold long, x array<double>, cell int, d double, chunk string, tile long, reach double, lo array<double>, hi array<double>"))
    chunks = looked.groupBy("chunk", "cell").agg(F.min("d").alias("from"), F.max("d").alias("to"), F.min("tile").alias("tile"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    wants = chunks.select("tile", F.arrays_zip("lo", "hi").alias("w")).select("tile", F.posexplode("w").alias("cell", "w")).select("tile", "cell", "w.lo", "w.hi")
    sent = wants.join(chunks.select("chunk", "cell", "from", "to"), "cell").filter("to >= lo and from <= hi").select("chunk", "tile").distinct()
    split = F.pmod(F.xxhash64("chunk", "id"), F.lit(splits))
    nothing = F.lit(None).cast("double")
    past = looked.drop("tile").join(sent, "chunk").select("tile", split.alias("split"), F.lit(1).alias("side"), "id", "fold", "x", "cell", nothing.alias("reach"))
    held = looked.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long"))).alias("split"), F.lit(0).alias("side"), "id", "fold", "x", "cell", "reach")
    both = held.unionByName(past).repartitionById(tiles * splits, (F.col("tile") * splits + F.col("split")).cast("int")).sortWithinPartitions("tile", "split", "side", "cell")

    def compare(batches):
        """A partition holds tiles after each other: of each the rows to keep, then those that stream past."""
        import pyarrow as pa

        now, mine, ids, best = None, [], None, None

        def done():
            if ids is not None:
                i, rank = np.nonzero(np.isfinite(best[1]))
                for at in range(0, len(i), 50_000):
                    a, b = i[at : at + 50_000], rank[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(best[0][a, b]), pa.array(best[1][a, b])], ["id", "neighbour", "square"])

        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "split", "side", "id", "fold", "cell", "reach")}
            xs = batch.column("x").flatten().to_numpy().reshape(-1, dims)
            key = np.stack([cols["tile"], cols["split"], cols["side"]], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                at = tuple(key[lo, :2].tolist())
                if at != now:
                    yield from done()
                    now, mine, ids = at, [], None
                if key[lo, 2] == 0:
                    mine.append((cols["id"][lo:hi], cols["fold"][lo:hi], xs[lo:hi], cols["reach"][lo:hi].copy()))
                    continue
                if not mine:
                    continue
                if ids is None:
                    ids, fold, x, reach = (np.concatenate(c) for c in zip(*mine))
                    d = np.sqrt(np.stack([_exact(p, x) for p in posts], axis=1))
                    best = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), np.inf)
                for to in range(lo, hi, BLOCK):
                    other = slice(to, min(hi, to + BLOCK))
                    y, cell = xs[other], cols["cell"][other]
                    asks = np.zeros(len(ids), bool)
                    for c in np.unique(cell):
                        away = np.sqrt(_exact(posts[c], y[cell == c]))
                        far, room = np.sqrt(reach), 1e-9 * (1 + d[:, c])
                        asks |= (d[:, c] - far - room <= away.max()) & (d[:, c] + far + room >= away.min())
                    asking = np.flatnonzero(asks)
                    for a in range(0, len(asking), BLOCK):
                        own = asking[a : a + BLOCK]
                        i, names, square = _meet(ids[own], fold[own], x[own], reach[own], cols["id"][other], cols["fold"][other], y, k, folds)
                        if not len(i):
                            continue
                        some, inverse = np.unique(i, return_inverse=True)
                        start = np.searchsorted(inverse, np.arange(len(some))) if (np.diff(inverse) >= 0).all() else None
                        if start is None:
                            order = np.argsort(inverse, kind="stable")
                            inverse, names, square = inverse[order], names[order], square[order]
                            start = np.searchsorted(inverse, np.arange(len(some)))
                        place = np.arange(len(inverse)) - start[inverse]
                        new = np.zeros((len(some), 2 * k), np.int64), np.full((len(some), 2 * k), np.inf)
                        new[0][:, :k], new[1][:, :k] = best[0][own[some]], best[1][own[some]]
                        new[0][inverse, k + place], new[1][inverse, k + place] = names, square
                        order = np.lexsort((new[0], new[1]), axis=1)[:, :k]
                        best[0][own[some]], best[1][own[some]] = (np.take_along_axis(c, order, axis=1) for c in new)
                        reach[own[some]] = np.minimum(reach[own[some]], best[1][own[some], k - 1])
        yield from done()

    found = both.mapInArrow(compare, "id long, neighbour long, square double")
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("square", "neighbour"))), 1, k).alias("n"))  # k of each split
    out = best.select("id", F.posexplode("n").alias("rank", "n"))
    return out.select(F.col("id").alias(id_col), (F.col("rank") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"), F.sqrt("n.square").alias("distance"))


def knn_predictions(rows: DataFrame, label: str, features: list[str], k: int = 1, id_col: str = "id", folds: int = 2, seed: int = 1, **sizes) -> DataFrame:
    """(id, label, predicted): the most frequent label among the k nearest rows of other folds, equal counts by least label. Folds are hashes of the
    id and the seed."""
    z = rows.dropna(subset=[id_col, label, *features]).withColumn("__fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)))
    near = nearest_neighbours(z, features, k, id_col, "__fold", **sizes)
    named = near.join(z.select(F.col(id_col).alias("neighbour"), F.col(label).alias("__l")), "neighbour")
    votes = named.groupBy(id_col, "__l").agg(F.count(F.lit(1)).alias("__n")).groupBy(id_col).agg(F.min_by("__l", F.struct(-F.col("__n"), "__l")).alias("predicted"))
    return z.select(id_col, label).join(votes, id_col)
