"""What the text operators share: table access, shared folder, words and the learning mask."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Entries of a word cache in a worker process; most distinct words of a large table occur once.
CACHE_ENTRIES = 200_000
#: Rows of whole texts that the JVM and a Python worker hold at a time.
BATCH_ROWS = 2_000
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of few rows, in this session from now on; it bounds memory and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo; NULL ids have none and are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def one_per_id(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each id, that with the smallest hash of its other columns, so that a bound on ids bounds the rows.

    Copies of an id are reduced inside the map tasks, before the shuffle.
    """
    rest = [c for c in rows.columns if c != key]
    least = F.min(F.struct(F.xxhash64(*rest).alias("_hash"), *rest)).alias("_row")
    return rows.groupBy(key).agg(least).select(key, *[F.col("_row")[c].alias(c) for c in rest])


def bounded_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest hash of their key: the same ones at every run."""
    return rows.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(n)
