"""Counts of what two nodes of a network have in common, by tiles of pairs of nodes instead of a row for each path of two edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.iterate import cut

#: Arcs of one side of a tile; paths of two edges, and cells of counts, that are held at once, but for one node's.
SIDE_ARCS, HELD_PATHS, HELD_CELLS = 1 << 22, 1 << 21, 1 << 23


def _products(rows, mids, values, columns, at, others, size, width):
    """(first row, end, keys, sums), some rows at a time: for pairs of rows and columns, keyed row * width + column, sums over common mids of products of
    values. rows: where each row's mids begin; columns, others: column and value of the arcs at[m]..at[m + 1] of mid m. keys None: sums are dense."""
    many = size[mids]
    paths = np.concatenate([[0], np.cumsum(many)])[rows]
    first, n = 0, len(rows) - 1
    while first < n:
        end = min(int(np.searchsorted(paths, paths[first] + HELD_PATHS, "right")) - 1, first + HELD_CELLS // max(width, 1))
        end = min(max(end, first + 1), n)
        some, k = slice(rows[first], rows[end]), int(paths[end] - paths[first])
        reps = many[some]
        pick = np.repeat(at[mids[some]] - np.cumsum(reps) + reps, reps) + np.arange(k)
        keys = np.repeat(np.repeat(np.arange(end - first), np.diff(rows[first : end + 1])) * width, reps) + columns[pick]
        x = None if values is None else np.repeat(values[some], reps) * others[pick]
        if (end - first) * width <= 16 * k:
            yield first, end, None, np.bincount(keys, x, (end - first) * width)
        elif x is None:
            yield first, end, *np.unique(keys, return_counts=True)
        else:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            begin = np.flatnonzero(np.diff(keys, prepend=-1))
            yield first, end, keys[begin], np.add.reduceat(x[order], begin) if k else x
        first = end


def _pairs(tile):
    """Pairs with a common neighbour or an edge: degrees, common neighbours, edge (1 or 0)."""
    n, (nodes, degree), same = tile["width"], tile["columns"], tile["same"]
    for first, end, keys, c in _products(*tile["products"]):
        if keys is None:
            keys = np.flatnonzero(c)
            c = c[keys]
        i, j = tile["row"], tile["column"]
        some = slice(*np.searchsorted(i, [first, end]))
        own = np.unique((i[some] - first) * n + j[some])
        every = np.union1d(keys, own)
        count, a = np.zeros(len(every), np.int64), np.zeros(len(every), np.int32)
        count[np.searchsorted(every, keys)] = c
        a[np.searchsorted(every, own)] = 1
        x, y = every // n + first, every % n
        keep = tile["rows"][0][x] < nodes[y] if same else np.ones(len(every), bool)
        x, y, count, a = x[keep], y[keep], count[keep], a[keep]
        s, d, da, db = tile["rows"][0][x], nodes[y], tile["rows"][1][x], degree[y]
        turn = s > d
        yield {"src": np.where(turn, d, s), "dst": np.where(turn, s, d), "da": np.where(turn, db, da), "db": np.where(turn, da, db), "c": count, "a": a}


def _at_edges(tile):
    """(rows, columns, values, sums of products) of a tile's arcs."""
    n = tile["width"]
    for first, end, keys, c in _products(*tile["products"]):
        some = slice(*np.searchsorted(tile["row"], [first, end]))
        i, j = tile["row"][some], tile["column"][some]
        at = (i - first) * n + j
        if keys is None:
            got = c[at]
        else:
            k = np.minimum(np.searchsorted(keys, at), max(len(keys) - 1, 0))
            got = np.where(keys[k] == at, c[k], 0) if len(keys) else np.zeros(len(at))
        yield i, j, tile["value"][some], got


def _edges(tile):
    """Edges as given (value 1; 0: turned): degrees and common neighbours of their ends."""
    (a, da), (b, db) = tile["rows"], tile["columns"]
    for i, j, own, c in _at_edges(tile):
        for x, turned in ((own == 1, False), (own == 0, True)):
            if tile["same"]:
                x = x & (own == 1)  # the other direction is in the tile as well
            s, d = (a[i[x]], b[j[x]])
            k, m = da[i[x]], db[j[x]]
            yield {"src": d, "dst": s, "da": m, "db": k, "c": c[x]} if turned else {"src": s, "dst": d, "da": k, "db": m, "c": c[x]}


def _triangles(tile):
    """Sums over nodes of the products of values around triangles, each of which two edges of a node bring once."""
    total = [np.zeros(len(x)) for x, _ in (tile["rows"], tile["columns"])]
    for i, j, s, c in _at_edges(tile):
        total[0] += np.bincount(i, s * c, len(total[0]))
        if not tile["same"]:
            total[1] += np.bincount(j, s * c, len(total[1]))
    yield {"node": tile["rows"][0], "sum": total[0]}
    if not tile["same"]:
        yield {"node": tile["columns"][0], "sum": total[1]}


def _tiled(arcs: DataFrame, keys: list[str], columns: str, fn, weighted: bool) -> DataFrame:
    """(keys, columns) from fn(tile) -> pieces. arcs (keys, src, dst, s, one), both directions of every edge; one adds up to a node's degree.

    A node's neighbours are one list. Nodes are dealt into parts, as many as keep a part's arcs under SIDE_ARCS and give each core about four tiles
    in all; a pair of parts is a tile, which gets the lists of both, so that a list is sent once for each part of its network."""
    spark, names = arcs.sparkSession, keys
    keys = [f"__k{i}" for i in range(len(keys))]
    arcs = arcs.withColumnsRenamed(dict(zip(names, keys)))
    lists = arcs.groupBy(*keys, "src").agg(F.collect_list("dst").alias("dst"), *([F.collect_list("s").alias("s")] if weighted else []), F.sum("one").cast("int").alias("degree"))
    lists = cut(lists.filter(" and ".join(f"{k} is not null" for k in (*keys, "src"))))  # read three times
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = lists.groupBy(*keys).agg(F.sum(F.size("dst")).alias("__n"))
    total = size.agg(F.sum("__n")).first()[0] or 1
    large = size.withColumn("__parts", F.greatest(F.ceil(F.col("__n") / SIDE_ARCS), F.ceil(F.sqrt(2.0 * F.col("__n") * tasks / total))).cast("int")).filter(f"__n > {SIDE_ARCS} or __n * {tasks} > {total}").drop("__n")
    dealt = lists.join(F.broadcast(large), keys, "left").withColumn("__parts", F.coalesce("__parts", F.lit(1))).withColumn("__part", F.pmod(F.xxhash64("src"), F.col("__parts")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).withColumns({"__a": F.least("__part", "__other"), "__b": F.greatest("__part", "__other")})
    kinds = ", ".join([*(f"{n} {dealt.schema[k].dataType.simpleString()}" for n, k in zip(names, keys)), columns])
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("src").combine_chunks()
        key, a, b = [table[k][0] for k in keys], table["__a"][0].as_py(), table["__b"][0].as_py()
        src, part, degree = (table[c].to_numpy() for c in ("src", "__part", "degree"))
        long = np.diff(table["dst"].chunk(0).offsets.to_numpy())
        flat, s = table["dst"].chunk(0).flatten().to_numpy(zero_copy_only=False), table["s"].chunk(0).flatten().to_numpy() if weighted else None
        del table
        mids, mid = np.unique(flat, return_inverse=True)
        node = np.searchsorted(src, flat)  # of neighbours whose list is here, the place among the lists
        node[node == len(src)] = 0
        here = src[node] == flat
        owner = np.repeat(np.arange(len(src)), long)
        x, y = np.flatnonzero(part == a), np.flatnonzero(part == b)
        place = np.full(len(src), -1)
        place[y] = np.arange(len(y))
        of_a, of_b = part[owner] == a, np.flatnonzero(part[owner] == b)
        of_b = of_b[np.argsort(mid[of_b], kind="stable")]
        size = np.bincount(mid[of_b], minlength=len(mids))
        tile = {"same": a == b, "rows": (src[x], degree[x]), "columns": (src[y], degree[y]), "width": len(y)}
        value = None if s is None else s[of_a]
        products = not weighted or fn is not _edges
        tile["products"] = np.concatenate([[0], np.cumsum(long[x])]), mid[of_a], value if products else None, place[owner[of_b]], np.concatenate([[0], np.cumsum(size)]), None if s is None or not products else s[of_b], size, len(y)
        at_row = np.repeat(np.arange(len(x)), long[x])
        linked = here[of_a] & (place[node[of_a]] >= 0)
        tile |= {"row": at_row[linked], "column": place[node[of_a]][linked], "value": None if s is None else value[linked]}
        if not len(x) or not len(y):
            return
        for piece in fn(tile):
            if n := len(next(iter(piece.values()))):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(k, n).cast(f.type) for k, f in zip(key, schema)), *(pa.array(piece[f.name], f.type) for f in list(schema)[len(key) :])], schema=schema)

    return dealt.select(*keys, "__a", "__b", "__part", "src", "dst", "degree", *(["s"] if weighted else [])).repartition(4 * tasks, *keys, "__a", "__b").groupBy(*keys, "__a", "__b").applyInArrow(run, kinds)


def _ends(df: DataFrame) -> str:
    return f"src {df.schema['src'].dataType.simpleString()}, dst {df.schema['dst'].dataType.simpleString()}"


def _counted(edges: DataFrame, keys: list[str]) -> DataFrame:
    one = (F.col("w") >= 0).cast("int")
    return edges.select(*keys, F.explode(F.array(F.struct("src", "dst", F.lit(1).alias("s")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("s")))).alias("e"), one.alias("one")).select(*keys, "e.*", "one")


def common(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, da, db, c, a), src < dst, of pairs that share a neighbour or an edge: degrees, common neighbours, edge (1 or 0)."""
    return _tiled(_counted(edges, keys).drop("s"), keys, f"{_ends(edges)}, da int, db int, c long, a int", _pairs, False)


def common_of_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, da, db, c) of the edges of a network without loops, each given once: degrees and common neighbours of their ends."""
    return _tiled(_counted(edges, keys), keys, f"{_ends(edges)}, da int, db int, c long", _edges, True)


def triangle_sums(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, sum) of links (keys, x, y, s), both directions of every linked pair: over the ordered pairs of x's neighbours, the products of the three s
    around a triangle."""
    arcs = links.select(*keys, F.col("x").alias("src"), F.col("y").alias("dst"), F.col("s").cast("double").alias("s"), F.lit(1).alias("one"))
    return _tiled(arcs, keys, f"node {arcs.schema['src'].dataType.simpleString()}, sum double", _triangles, True).groupBy(*keys, F.col("node").alias("x")).agg(F.sum("sum").alias("sum"))
