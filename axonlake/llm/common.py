"""Small helpers shared by the corpus operators: shared scratch tables, text rules, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z only; every other character is left alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, one of our own on a local master (tests), which
    has one machine only, and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="axonlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut there, and a lost executor costs no rework before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/axonlake-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._axon_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table that stage_table wrote and that nothing reads any more."""
    path = getattr(df, "_axon_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def only_result(df: DataFrame, label: str, *used: DataFrame) -> DataFrame:
    """df written to the shared folder, after which the staged tables that it was made from are deleted."""
    out = stage_table(df, label)
    for x in used:
        drop_staged(x)
    return out


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_bytes(value) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def byte_ngram_hashes(data: bytes, n: int, bits: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of n bytes, as indices below 2**bits."""
    return ngram_hashes(np.frombuffer(data, np.uint8), n, bits, salt)


def ngram_hashes(a: np.ndarray, n: int, bits: int, salt: int = 0) -> np.ndarray:
    """Hash of every window of n units (bytes or code points), as indices below 2**bits."""
    m = len(a) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    h = np.full(m, (2166136261 + 7919 * (n + salt)) & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h ^= a[i : i + m]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)
