"""GARCH(1,1) over series too long for one task.

The variance recursion ``h[t+1] = w + a e[t]**2 + b h[t]`` is affine in ``h``, so a block of ``n`` rows maps the
variance before it to ``b**n * h + s`` with ``s`` the block's variance when it starts from zero.  Blocks report that map
for every parameter of a grid, the maps compose by doubling, and each block then adds up its own part of
every likelihood.  A task holds one block; what crosses blocks is one row per block and parameter grid.

Rows need a position ``_pos`` (``blocks.number_rows``) in the order training, then test.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.series import Series
from barloom.operators import timeseries as ts
from barloom.operators.blocks import DEFAULT_BLOCK
from barloom.plans.session import cut_lineage

DOUBLES = T.ArrayType(T.DoubleType())


def filled_returns(numbered: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """``_block`` and ``_r``: training returns as they are, test returns carried forward (0 before the first one)."""
    rows = numbered.withColumn("_block", F.floor(F.col("_pos") / block_rows))
    test = F.when(F.col("split") == "test", F.col("ret_lag1"))
    last = F.last(test, ignorenulls=True)
    ends = rows.groupBy(*keys, "_block").agg(F.max_by(test, F.when(test.isNotNull(), F.col("_pos"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_block", F.last("_end", ignorenulls=True).over(before).alias("_entered"))
    within = Window.partitionBy(*keys, "_block").orderBy("_pos")
    carried = F.coalesce(last.over(within), F.col("_entered"), F.lit(0.0))
    return rows.join(ends, [*keys, "_block"]).withColumn(
        "_r", F.when(F.col("split") == "train", F.col("ret_lag1")).otherwise(carried)
    ).drop("_entered")


def block_arrays(rows: DataFrame, levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per block: squared residuals in order, and how many of them are training rows (these come first)."""
    square = F.pow(F.col("_r") - F.col("mu"), 2)
    packed = rows.join(levels, list(keys)).groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct("_pos", square.alias("q")))).alias("_p"),
        F.count(F.when(F.col("split") == "train", 1)).cast("int").alias("n_train"),
        F.min("s2").alias("s2"),
    )
    return packed.select(*keys, "_block", "s2", "n_train", F.col("_p.q").alias("q"))


def _levels(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    train = rows.filter("split = 'train'")
    return train.groupBy(*keys).agg(
        F.count("_r").alias("n"), F.avg("_r").alias("mu"), F.var_pop("_r").alias("s2"), F.var_samp("_r").alias("_v")
    ).filter((F.col("n") >= ts.GARCH_MIN_OBS) & (F.col("s2") > 0))


def _paths(q: np.ndarray, s2: float, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Variance before each row and after the last one, for a vector of parameters."""
    h = np.empty((len(q) + 1, len(a)))
    h[0] = start
    omega = s2 * (1 - a - b)
    for t in range(len(q)):
        h[t + 1] = omega + a * q[t] + b * h[t]
    return h


def _schema(df: DataFrame, keys: Sequence[str], *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [df.schema[k] for k in (*keys, "_block")]
    return T.StructType([*fields, *[T.StructField(name, kind) for name, kind in more]])


def _entering(blocks: DataFrame, grid: DataFrame, keys: Sequence[str], most_blocks: int, train_only: bool) -> DataFrame:
    """``blocks`` with the parameters and ``_in``, the variance before the block for each of them."""
    joined = blocks.join(grid, list(keys))
    if train_only:
        joined = joined.filter("n_train > 0")
    if most_blocks <= 1:
        return joined.withColumn("_in", F.transform("a", lambda _: F.col("s2")))
    out = _schema(joined, keys, ("_w", DOUBLES), ("_s", DOUBLES))

    def ends(parts):
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                a, b = np.array(row.a), np.array(row.b)
                q = np.asarray(row.q)[: row.n_train] if train_only else np.asarray(row.q)
                first = row.first
                h = _paths(q, row.s2, a, b, np.full(len(a), row.s2 if first else 0.0))[-1]
                rows.append((np.zeros(len(a)) if first else b ** len(q), h))
            done = part[[*keys]].copy()
            done["_block"] = part["block_id"]
            done["_w"], done["_s"] = [w for w, _ in rows], [s for _, s in rows]
            yield done

    s = Series(tuple(keys), ("_block",))
    maps = joined.select(
        *keys, F.col("_block").alias("block_id"), (F.col("_block") == 0).alias("first"), "s2", "n_train", "q", "a", "b"
    ).mapInPandas(ends, out)
    for k in range(max(1, math.ceil(math.log2(most_blocks)))):
        step = 1 << k
        maps = maps.withColumns({"_pw": s.lag("_w", step), "_ps": s.lag("_s", step)})
        reaches = F.col("_pw").isNotNull()
        maps = maps.withColumns({
            "_s": F.when(reaches, F.zip_with("_s", F.zip_with("_w", "_ps", lambda w, p: w * p), lambda x, y: x + y)).otherwise(F.col("_s")),
            "_w": F.when(reaches, F.zip_with("_w", "_pw", lambda w, p: w * p)).otherwise(F.col("_w")),
        })
    maps = maps.select(*keys, "_block", s.lag("_s", 1).alias("_prev"))
    flat = F.transform("a", lambda _: F.col("s2"))
    return joined.join(maps, [*keys, "_block"]).withColumn("_in", F.coalesce("_prev", flat)).drop("_prev")


def _likelihoods(entered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key, index of the candidate and its log likelihood over all training rows.  Blocks add their sums, the rest is an aggregate."""
    out = _schema(entered, keys, ("ll", DOUBLES))

    def score(parts):
        for part in parts:
            sums = []
            for row in part.itertuples(index=False):
                a, b, q = np.array(row.a), np.array(row.b), np.asarray(row.q)[: row.n_train]
                h = np.maximum(_paths(q, row.s2, a, b, np.asarray(row.entry))[:-1], 1e-300)
                sums.append(np.concatenate([ts.squared_t_loglik(q, h, nu) for nu in row.nu]))
            done = part[[*keys]].copy()
            done["_block"], done["ll"] = part["block_id"], sums
            yield done

    parts = entered.select(
        *keys, F.col("_block").alias("block_id"), "s2", "n_train", "q", "a", "b", "nu", F.col("_in").alias("entry")
    ).mapInPandas(score, out)
    return parts.select(*keys, F.posexplode("ll").alias("i", "ll")).groupBy(*keys, "i").agg(F.sum("ll").alias("ll"))


def _first_round(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every series before its first round: no best point yet, the fixed grid to try."""
    a, b, nu = (F.array(*[F.lit(float(x)) for x in v]) for v in ts.candidates("garch11"))
    none = F.lit(None).cast("double")
    return levels.select(
        *keys, *[none.alias(c) for c in ("a0", "b0", "nu0", "ll0")], F.lit(1.0).alias("width"), F.lit(0).alias("still"),
        a.alias("a"), b.alias("b"), nu.alias("nu"),
    )


def _next_round(state: DataFrame, scored: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """The best point of each series so far and what to try around it.

    The update is an Arrow map rather than columns: a checkpoint keeps the constraints of its plan, and
    expressions over last round's columns would make them grow from round to round.
    """
    top = scored.groupBy(*keys).agg(F.max(F.struct("ll", (-F.col("i")).alias("i"))).alias("_t"))
    joined = state.join(top.select(*keys, F.col("_t.ll").alias("ll"), (-F.col("_t.i")).alias("i")), list(keys))

    def advance(parts):
        for part in parts:
            made = []
            for row in part.itertuples(index=False):
                i, j = divmod(int(row.i), len(row.a))
                best = None if math.isnan(row.ll0) else row.ll0
                width, still = ts.closer(best, row.ll, row.width, row.still, tolerance)
                a, b, nu = float(row.a[j]), float(row.b[j]), float(row.nu[i])
                made.append((a, b, nu, row.ll, width, still, *ts.candidates("garch11", (a, b, nu), width)))
            done = part[[*keys]].copy()
            for c, name in enumerate(("a0", "b0", "nu0", "ll0", "width", "still", "a", "b", "nu")):
                done[name] = [m[c] for m in made]
            yield done

    return joined.mapInPandas(advance, state.schema)


def fit(blocks: DataFrame, levels: DataFrame, keys: Sequence[str], most_blocks: int, tolerance: float = ts.TOLERANCE) -> DataFrame:
    """(keys, a, b, nu, ll) of the largest likelihood, by the search of ``timeseries.fit_variance``.

    A round is two passes over the blocks of the series that still gain; the driver sees whether any are left.
    """
    state, finished = _first_round(levels, keys), []
    for _ in range(ts.MAX_ROUNDS):
        scored = _likelihoods(_entering(blocks, state.select(*keys, "a", "b", "nu"), keys, most_blocks, True), keys)
        state = cut_lineage(_next_round(state, scored, keys, tolerance))
        finished.append(state.filter(F.col("still") >= ts.STILL_ROUNDS))
        state = state.filter(F.col("still") < ts.STILL_ROUNDS)
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*finished, state]).select(
        *keys, F.col("a0").alias("a"), F.col("b0").alias("b"), F.col("nu0").alias("nu"), F.col("ll0").alias("ll")
    )


def variance_paths(
    numbered: DataFrame, keys: Sequence[str] = ("fold", "asset"), block_rows: int = DEFAULT_BLOCK, tolerance: float = ts.TOLERANCE
) -> DataFrame:
    """``timeseries.variance_paths`` of the ``garch11`` variant for numbered rows (keys, split, date, ret_lag1, ``_pos``)."""
    rows = cut_lineage(filled_returns(numbered, keys, block_rows))
    levels = cut_lineage(_levels(rows, keys))
    blocks = cut_lineage(block_arrays(rows, levels, keys))
    most = blocks.agg(F.max("_block")).head()[0]
    plain = rows.select(*keys, "date", "split", "_pos", "_block")
    if most is None:
        none = F.lit(None).cast("double")
        return plain.select(
            *keys, "date", "split", none.alias("h_now"), none.alias("h_next"),
            F.lit(ts.DEFAULT_LOG_VAR).alias("fallback"), F.lit(False).alias("fitted"),
        )
    fitted = fit(blocks, levels, keys, most + 1, tolerance).filter(F.col("a") + F.col("b") < ts.STABLE_BELOW)
    one = cut_lineage(fitted.select(*keys, F.array("a").alias("a"), F.array("b").alias("b"), F.array("nu").alias("nu")))
    entered = _entering(blocks, one, keys, most + 1, False)
    out = _schema(entered, keys, ("h", DOUBLES))

    def path(parts):
        for part in parts:
            done = part[[*keys]].copy()
            done["_block"] = part["block_id"]
            done["h"] = [
                np.maximum(_paths(np.asarray(r.q), r.s2, np.array(r.a), np.array(r.b), np.asarray(r.entry))[:, 0], 1e-300)
                for r in part.itertuples(index=False)
            ]
            yield done

    paths = entered.select(
        *keys, F.col("_block").alias("block_id"), "s2", "q", "a", "b", F.col("_in").alias("entry")
    ).mapInPandas(path, out)
    k = (F.col("_pos") - F.col("_block") * block_rows).cast("int")
    level = levels.select(*keys, F.ln(F.greatest("_v", F.lit(1e-12))).alias("_fallback"))
    each = F.posexplode(F.arrays_zip(F.slice("h", 1, F.size("h") - 1).alias("now"), F.slice("h", 2, F.size("h") - 1).alias("next")))
    days = paths.select(*keys, "_block", each.alias("_k", "_h")).select(
        *keys, (F.col("_block") * block_rows + F.col("_k")).alias("_pos"), F.col("_h.now").alias("h_now"), F.col("_h.next").alias("h_next")
    )
    return plain.join(days, [*keys, "_pos"], "left").join(level, list(keys), "left").select(
        *keys, "date", "split", "h_now", "h_next",
        F.coalesce("_fallback", F.lit(ts.DEFAULT_LOG_VAR)).alias("fallback"), F.col("h_now").isNotNull().alias("fitted"),
    )
