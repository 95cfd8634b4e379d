"""Exponentially weighted mean ``y[t] = (1-a) y[t-1] + a x[t]`` without a sequential loop.

The recursion is a decayed sum over the past, and a decayed sum can be doubled: if ``s``
holds the sum over the last ``m`` rows, then ``s[t] + d**m * s[t-m]`` holds it over the
last ``2m``.  Doubling goes on until ``d**m`` is zero in double precision, so no row that still
has a weight is left out, however small: after a long flat stretch two smoothed columns
keep the ratio that the recursion gives them.  Each step is an ordinary window
expression on the same partitioning: one exchange, one sort, no state, no UDF.

A series too long for one task is cut into blocks.  Over a block of ``n`` rows the mean is an
affine map of the value before it, ``y -> d**n * (y - x) + z`` with ``x`` the block's first input and ``z``
its last mean when smoothed alone; maps compose, and composing is the same doubling.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series
from barloom.operators.blocks import DEFAULT_BLOCK

SMALLEST = 5e-324  # the smallest positive double


def memory(alpha: float) -> int:
    """Rows after which a weight is zero in double precision."""
    return max(1, math.ceil(math.log(SMALLEST) / math.log(1.0 - alpha)))


def from_span(span: float) -> float:
    return 2.0 / (span + 1.0)


def add_ewm(
    df: DataFrame, specs: dict[str, tuple[str, float]], series: Series | None = None
) -> DataFrame:
    """Add ``{output: (input column, alpha)}`` smoothed columns.

    The first non-null input of a series enters with weight one.  NULLs are allowed
    only before it; drop interior NULLs first (or partition them away).
    """
    s = series or Series()
    first = {}
    for out, (name, alpha) in specs.items():
        x = F.col(name)
        started = F.count(x).over(s.running)
        first[f"_n_{out}"] = started
        first[out] = F.coalesce(F.when(started == 1, x).otherwise(x * alpha), F.lit(0.0))
    df = df.withColumns(first)
    step = 1
    while True:
        live = {o: a for o, (_, a) in specs.items() if memory(a) > step}
        if not live:
            break
        df = df.withColumns(
            {
                o: F.col(o) + F.coalesce(s.lag(o, step), F.lit(0.0)) * ((1.0 - a) ** step)
                for o, a in live.items()
            }
        )
        step *= 2
    return df.withColumns(
        {o: F.when(F.col(f"_n_{o}") > 0, F.col(o)) for o in specs}
    ).drop(*[f"_n_{o}" for o in specs])


def add_ewm_blocks(
    numbered: DataFrame,
    specs: dict[str, tuple[str, float]],
    keys: Sequence[str] = ("asset",),
    block_rows: int = DEFAULT_BLOCK,
) -> DataFrame:
    """``add_ewm`` for rows with a position ``_pos`` (``blocks.number_rows``), without a task that holds a series.

    Each block is smoothed alone, one row per block carries its map to the blocks after it, and the
    value before a block then enters its rows with the weight that is left of it.  A series
    of 1e11 rows has 1.5 million blocks, so the maps are a small table.
    """
    rows = numbered.withColumn("_block", F.floor(F.col("_pos") / block_rows))
    by = (*keys, "_block")
    alone = add_ewm(rows, specs, Series(by, ("_pos",)))
    ends = [F.count(F.lit(1)).alias("_rows")]
    for out, (name, _) in specs.items():
        ends.append(F.max_by(out, "_pos").alias(f"_z_{out}"))
        ends.append(F.min_by(name, "_pos").alias(f"_x_{out}"))
    carried = _before(alone.groupBy(*by).agg(*ends), specs, keys, block_rows)
    kept = [F.col(c) for c in alone.columns if c not in specs and c != "_block"]
    smoothed = []
    for out, (_, alpha) in specs.items():
        left = F.pow(F.lit(1.0 - alpha), (F.col("_pos") % block_rows + 1).cast("double"))
        entered = F.col(f"_in_{out}") - F.col(f"_x_{out}")
        smoothed.append((F.col(out) + F.coalesce(left * entered, F.lit(0.0))).alias(out))
    return alone.join(carried, list(by)).select(*kept, *smoothed)


def _before(
    ends: DataFrame, specs: dict[str, tuple[str, float]], keys: Sequence[str], block_rows: int
) -> DataFrame:
    """The smoothed value before each block (NULL where the series has not begun) and its first input."""
    s = Series(keys, ("_block",))
    earlier = s.spec.rowsBetween(Window.unboundedPreceding, -1)
    maps = {}
    for out, (_, alpha) in specs.items():
        z, x = F.col(f"_z_{out}"), F.col(f"_x_{out}")
        weight = F.pow(F.lit(1.0 - alpha), F.col("_rows").cast("double"))
        begun = F.count(z).over(earlier) > 0
        maps[f"_w_{out}"] = F.when(begun, weight).otherwise(0.0)
        maps[f"_s_{out}"] = F.when(begun, z - weight * x).otherwise(z)
    ends = ends.withColumns(maps)
    step = 1
    while True:
        live = [o for o, (_, a) in specs.items() if memory(a) > (step - 1) * block_rows]
        if not live:
            break
        more = {}
        for o in live:
            more[f"_s_{o}"] = F.col(f"_s_{o}") + F.coalesce(F.col(f"_w_{o}") * s.lag(f"_s_{o}", step), F.lit(0.0))
            more[f"_w_{o}"] = F.col(f"_w_{o}") * F.coalesce(s.lag(f"_w_{o}", step), F.lit(0.0))
        ends = ends.withColumns(more)
        step *= 2
    return ends.select(
        *keys, "_block",
        *[F.col(f"_x_{o}") for o in specs],
        *[s.lag(f"_s_{o}", 1).alias(f"_in_{o}") for o in specs],
    )
