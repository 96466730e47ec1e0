"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive runs of bytes, most significant first: a round groups what is left by (group, next bytes,
whether the text ends here). Groups of one are finished, groups whose text has ended are sets of equal texts, and only the rest
goes to the next round with the bytes not yet compared. The run of bytes widens each round, so rounds grow with the logarithm
of the longest text. Bytes themselves are compared: no digest decides equality.

Scale: a round is one partially aggregated groupBy on the radix key plus one join back. The group table is written before the
join, so a group that holds a third of the rows is a skewed join side that adaptive execution splits over tasks; nothing is
collected per group. Unfinished rows are written to the shared folder between rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, only_result, read_table, stage_table


def msd_radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_width: int = 256, growth: int = 16) -> DataFrame:
    """One row per input row: id, keep_id (largest id of equal texts), group_size, kept, text_sha256.

    Null text counts as empty. Rows that repeat both id and text are copies as well: one of them is kept. A null id is smaller than
    any other. An empty table gives an empty result; other columns are ignored.
    """
    if first_width < 1 or growth < 2:
        raise ValueError("first_width must be at least 1 and growth at least 2")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    left = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("gid"), body.alias("rest"), F.unhex(F.sha2(body, 256)).alias("sha"))
    width, round_, done, staged = first_width, 0, [], []
    while True:
        keyed = left.withColumns({"ended": F.octet_length("rest") <= width, "head": F.substring("rest", 1, width)})
        groups = keyed.groupBy("gid", "ended", "head").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
        groups = stage_table(groups.filter("n > 1").withColumn("next_gid", F.monotonically_increasing_id()), "radix-groups")
        joined = keyed.join(groups.hint("merge"), ["gid", "ended", "head"], "left")  # heads may be long, so groups are never broadcast
        open_ = F.col("n").isNotNull() & ~F.col("ended")
        joined = joined.select(
            "id", "sha", open_.alias("open"), F.col("next_gid").alias("gid"), F.coalesce("n", F.lit(1)).alias("n"),
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.when(open_, F.expr(f"substring(rest, {width + 1})")).alias("rest"), F.monotonically_increasing_id().alias("uid"),
        )
        joined = stage_table(joined, "radix-rows")
        drop_staged(groups)
        staged.append(joined)
        done.append(joined.filter("not open").select("id", "keep", "n", "sha", F.lit(round_).alias("round"), "gid", "uid"))
        left = joined.filter("open").select("id", "gid", "rest", "sha")
        if left.isEmpty():
            break
        width *= growth
        round_ += 1
    rows = reduce(DataFrame.unionByName, done)
    largest = F.col("id").eqNullSafe(F.col("keep"))
    # Rows of a group that hold its largest id: one of them stays. Each task reduces its own first, so that even a group of nothing but
    # repeats of one row passes a row per task only.
    stays = rows.filter((F.col("n") > 1) & largest).groupBy("round", "gid").agg(F.min("uid").alias("uid_")).select(F.col("round").alias("round_"), "uid_")
    marked = rows.join(stays.hint("merge"), (F.col("n") > 1) & (F.col("round") == F.col("round_")) & (F.col("uid") == F.col("uid_")), "left")
    out = marked.withColumn("kept", (F.col("n") == 1) | F.col("uid_").isNotNull())
    out = out.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))
    return only_result(out, "radix-result", *staged)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the row with the largest id of each set of equal texts; columns as they were.

    Rows that repeat id and text are reduced to one.
    """
    dropped = msd_radix_groups(docs, id_col, text_col).filter("not kept")
    copies = dropped.filter(~F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha")).distinct()
    twice = dropped.filter(F.col(id_col).eqNullSafe(F.col("keep_id"))).select(F.col(id_col).alias("__id"), F.unhex("text_sha256").alias("__sha")).distinct()
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (sha == F.col("__sha"))
    kept = docs.join(copies, same, "left_anti")
    if twice.isEmpty():
        return kept
    one = kept.join(twice, same).groupBy("__id", "__sha").agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")  # each task keeps one of its own first
    return kept.join(twice, same, "left_anti").unionByName(one)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty; of rows that repeat id and text one
    is kept; a null doc_id is smaller than any other."""
    return msd_radix_groups(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
