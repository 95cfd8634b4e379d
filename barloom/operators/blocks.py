"""Halo blocks: trailing windows over series too long for one task.

A daily panel bounds every series by the calendar, an intraday panel does not: one
instrument may hold a third of all rows.  Here rows get a position within their series
from two bounded steps (row numbers inside time buckets, plus the prefix sum of bucket
counts), are cut into blocks of ``block_rows``, and each block receives copies of the
``halo`` rows before it.  Any backward-looking window of at most ``halo`` rows then runs
per (key, block) in parallel and the copies are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 65_536


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``_pos``, the 0-based position of a row in its series.

    ``bucket`` must be monotone in ``order`` (a coarse time bucket, say); buckets should
    hold at most a few hundred thousand rows each.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start")
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        tagged.join(starts, [*keys, "_bucket"])
        .withColumn("_pos", F.col("_start") + F.row_number().over(inner) - 1)
        .drop("_bucket", "_start")
    )


def with_halo(numbered: DataFrame, halo: int, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Copy the rows each block looks back on into it; ``_own`` marks the originals."""
    if halo > block_rows:
        raise ValueError("block_rows must be at least the halo")
    home = F.floor(F.col("_pos") / block_rows)
    spill = F.col("_pos") % block_rows >= block_rows - halo
    homes = F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))
    return numbered.withColumn("_home", home).withColumn("_block", F.explode(homes)).withColumn(
        "_own", F.col("_block") == F.col("_home")
    ).drop("_home")


def blockwise(
    df: DataFrame,
    build: Callable[[DataFrame, tuple[str, ...]], DataFrame],
    *,
    halo: int,
    bucket: Column,
    keys: Sequence[str] = ("asset",),
    order: Sequence[str] = ("date",),
    block_rows: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Run ``build(df, keys)`` per block with enough history, then drop the halo rows.

    ``build`` must look back at most ``halo`` rows and never forward.
    """
    numbered = number_rows(df, keys, order, bucket)
    return on_blocks(numbered, build, halo=halo, keys=keys, block_rows=block_rows).drop("_pos")


def on_blocks(
    numbered: DataFrame,
    build: Callable[[DataFrame, tuple[str, ...]], DataFrame],
    *,
    halo: int,
    keys: Sequence[str] = ("asset",),
    block_rows: int = DEFAULT_BLOCK,
) -> DataFrame:
    """``blockwise`` for rows numbered before; keeps their ``_pos``."""
    done = build(with_halo(numbered, halo, block_rows), (*keys, "_block"))
    return done.filter("_own").drop("_own", "_block")
