"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the number of set bits in each segment gives a point in {0,1,2}^32.
Two fingerprints that differ in d bits lie at Manhattan distance d or less, so the distance of the points is a lower bound. The
point is kept in unary code (0, 1, 11 per segment): the Manhattan distance is then one popcount of an exclusive or.

The range join: the 32 coordinates form eight blocks of four. Points within distance 4 agree on at least four of the eight
blocks, so each point is put into the 70 grids made of four blocks, and only points of one grid cell are compared. A pair is
compared in the first grid that it shares, first by the lower bound and then by the exact Hamming distance.

Large cells: a cell of more than `cell_limit` fingerprints is parted further by the exact bits of its four blocks, since a pair at
distance four or less has at least four of its eight bytes in common. A pair is therefore listed in the grid of the four lowest bytes that
agree bit for bit, which its cell and its part of a large cell both contain. What stays larger than the limit even so is linked through
midpoints: two fingerprints are within d bits of each other exactly if some 64-bit value is within floor(d/2) bits of one and ceil(d/2)
bits of the other, so all members within ceil(d/2) of a value are linked to the least member within floor(d/2) of it, if there is one.
That is linear in the members, exact for every d, and loses no link between classes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, only_result, read_table, stage_table, text_bytes
from .components import connected_components

BLOCKS, AGREE = 8, 4
GRIDS = list(combinations(range(BLOCKS), AGREE))
#: By the set of bytes on which a pair agrees: the first grid made of four of them (that of the four lowest), or -1.
FIRST_GRID = [GRIDS.index(tuple(on[:AGREE])) if len(on := [b for b in range(BLOCKS) if mask >> b & 1]) >= AGREE else -1 for mask in range(1 << BLOCKS)]
EVEN_BITS = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_bytes(data: bytes, shingle: int = 4) -> int:
    """Fingerprint of the words of data, as an unsigned 64-bit integer; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [b" ".join(words)]
    digest, ones, step = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(shingles), step):
        h = np.array([digest(s, 42) for s in shingles[at : at + step]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint as a signed long. Null and empty texts have 0."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash_bytes(text_bytes(t.as_py()), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def embed(fp: Column) -> Column:
    """Segment popcounts in unary code."""
    low = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(EVEN_BITS))
    high = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(F.lit(EVEN_BITS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _grid_mask(grid) -> int:
    return _signed(sum(0xFF << (8 * b) for b in grid))


def near_links(fps: DataFrame, max_distance: int = 4, cell_limit: int = 256, staged: list | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links at max_distance or less.

    max_distance is at most 4, as the grids are laid out for it. In cells of up to cell_limit members every link is listed once.
    Staged tables that the result reads are added to `staged`.
    """
    staged = [] if staged is None else staged
    if not 0 <= max_distance <= BLOCKS - AGREE:
        raise ValueError("max_distance must be from 0 to 4")
    points = fps.select("fp").distinct().withColumn("point", embed(F.col("fp")))
    cells = F.array(*(F.struct(F.lit(i).cast("tinyint").alias("grid"), F.col("point").bitwiseAND(F.lit(_grid_mask(g))).alias("cell")) for i, g in enumerate(GRIDS)))
    dealt = points.select("fp", "point", F.explode(cells).alias("c")).select("fp", "point", "c.grid", "c.cell")
    dealt = dealt.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grid", "cell"))).filter("n > 1")
    dealt = stage_table(dealt, "simhash-cells")
    staged.append(dealt)
    exact = F.element_at(F.array(*(F.lit(_grid_mask(g)) for g in GRIDS)), F.col("grid") + 1).bitwiseAND(F.col("fp"))
    parted = dealt.filter(F.col("n") > cell_limit).withColumn("cell", exact)
    parted = parted.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grid", "cell"))).filter("n > 1")
    parted = stage_table(parted, "simhash-parts")
    staged.append(parted)
    apart, differ = F.col("a.point").bitwiseXOR(F.col("b.point")), F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    agreed = reduce(Column.bitwiseOR, (F.when(F.shiftrightunsigned(differ, 8 * k).bitwiseAND(F.lit(255)) == 0, 1 << k).otherwise(0) for k in range(BLOCKS)))
    first = F.element_at(F.array(*map(F.lit, FIRST_GRID)), agreed + 1)
    near = (F.bit_count(apart) <= max_distance) & (F.bit_count(differ) <= max_distance)
    same = (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))

    def listed(members: DataFrame) -> DataFrame:
        found = members.alias("a").join(members.alias("b"), same & near & (first == F.col("a.grid")))
        return found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    pairs = listed(dealt.filter(F.col("n") <= cell_limit))
    if parted.isEmpty():
        return pairs
    pairs = pairs.unionByName(listed(parted.filter(F.col("n") <= cell_limit)))
    large = parted.filter(F.col("n") > cell_limit)
    if large.isEmpty():
        return pairs
    flips = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    flips = F.array(*(F.struct(F.lit(_signed(x)).alias("x"), F.lit(x.bit_count()).alias("d")) for x in flips if x.bit_count() <= (max_distance + 1) // 2))
    members = stage_table(large.select("fp").distinct(), "simhash-large")
    staged.append(members)
    around = members.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip.x")).alias("mid"), "flip.d")
    root = around.filter(F.col("d") <= max_distance // 2).groupBy("mid").agg(F.min("fp").alias("a"))
    linked = around.join(root, "mid").filter("a <> fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()
    return pairs.unionByName(linked)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, cell_limit: int = 256) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id reachable over links at max_distance or less).

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id share nothing but their fingerprint.
    """
    fp = stage_table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage_table(fp.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    links, rounds = [], []
    parts = stage_table(connected_components(near_links(classes, max_distance, cell_limit, links), staged=rounds), "fingerprint-parts")
    for x in links + rounds:
        drop_staged(x)
    named = classes.join(parts, classes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    whole = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = stage_table(named.join(whole, "part").select(F.col("fp").alias("fp_"), "component_id"), "fingerprint-names")
    out = fp.join(named, fp.fp == named.fp_)
    out = out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return only_result(out, "simhash-classes", fp, classes, parts, named)


def op3_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint, component_id. Null and empty texts have fingerprint zero and link like any other; repeated rows
    are rows of their own; a null doc_id is never a component_id unless all ids of the component are null."""
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_neardup": op3_simhash_neardup}
ORACLE: dict[str, str] = {}
