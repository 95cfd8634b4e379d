"""Gradient-boosted trees over quantile-binned columns, for all folds, scopes and seeds at once.

A fit is (fold, scope, seed); a row belongs to the pooled scope and to its asset's.  Rows become blocks of bounded size
that hold small bin numbers.  A fit of one block is grown where the block lies, so many fits run side by side.  A
larger fit is grown level by level: one job for each level of all such fits, in which tasks add up gradient histograms of
their blocks and the sums choose the splits; only chosen splits reach the driver.  Both ways share the code
that samples, counts, splits and stops.

A tree is grown to a fixed depth and cut back to the best splits first, up to LEAVES leaves: a split's gain does not depend on
the order of splitting, so this is best-first growth.  After each round the validation rows are scored; a fit
ends when PATIENCE rounds bring no better score and keeps the trees up to its best round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.linear import MIN_TRAIN_ROWS, POOLED, SUFFIX
from barloom.plans.session import cut_lineage

# Fixed values.
DEPTH, LEAVES, MIN_LEAF, STEP, ROWS, COLUMNS, L2, L1, ROUNDS, PATIENCE = 4, 15, 60, 0.02, 0.8, 0.7, 5.0, 0.5, 2000, 100
MIN_HESSIAN = 1e-3
BINS = 64
BLOCK = 65_536
REFRESH = 25
NODES = 2 ** (DEPTH + 1) - 1
SPLITS = ("train", "val", "test")
BLOCKS = (
    "fold int, scope string, part int, parts int, asset array<string>, date array<date>, split binary, y binary, key binary, bins binary"
)
RESULT = (
    "fold int, scope string, seed int, asset string, date date, pred double, proba double, y_true double, feature int, gain double, rounds int"
)
SUMS = "fold int, scope string, seed int, node int, salt int, sums binary, loss double, seen long"
CHOSEN = "fold int, scope string, seed int, node int, feature int, bin int, gain double, g double, h double, n double, left_g double, left_h double, left_n double, loss double, seen long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


# -- trees ----------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes numbered level by level; a node without a feature is a leaf."""

    feature: np.ndarray = field(default_factory=lambda: np.full(NODES, -1, np.int32))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(NODES, np.int32))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(NODES))
    value: np.ndarray = field(default_factory=lambda: np.zeros(NODES))

    def place(self, bins: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        node, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[every, np.maximum(f, 0)] > self.bin[node]), node)
        return node

    def take(self, node: int, split: tuple) -> None:
        """Record the candidate split (feature, bin, gain, g, h, n, left g, left h, left n) of a node."""
        feature, at, gain, g, h, _, left_g, left_h, _ = split
        self.value[node] = leaf_value(g, h)
        if feature >= 0:
            self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
            self.value[2 * node + 1], self.value[2 * node + 2] = leaf_value(left_g, left_h), leaf_value(g - left_g, h - left_h)

    def best_first(self) -> Tree:
        """Keep the splits that best-first growth takes before there are LEAVES leaves."""
        kept, waiting = set(), [(-self.gain[0], 0)] if self.feature[0] >= 0 else []
        while waiting and len(kept) + 1 < LEAVES:
            node = heapq.heappop(waiting)[1]
            kept.add(node)
            for child in (2 * node + 1, 2 * node + 2):
                if self.feature[child] >= 0:
                    heapq.heappush(waiting, (-self.gain[child], child))
        for node in range(NODES):
            if node not in kept:
                self.feature[node] = -1
        return self


def soft(g):
    return np.sign(g) * np.maximum(np.abs(g) - L1, 0.0)


def leaf_value(g: float, h: float) -> float:
    return float(-STEP * soft(g) / (h + L2))


def sampled_rows(key: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """Which rows a round uses: a hash of the row's key, so it does not matter where the row lies."""
    x = key.view(np.uint64) ^ np.uint64((seed * 1_000_003 + round_) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) * 2.0**-53 < ROWS


def sampled_columns(width: int, seed: int, round_: int) -> np.ndarray:
    return np.sort(np.random.default_rng((seed, round_)).choice(width, max(1, int(COLUMNS * width)), replace=False))


def gradients(margin: np.ndarray, y: np.ndarray, classify: bool) -> tuple[np.ndarray, np.ndarray]:
    if not classify:
        return margin - y, np.ones(len(y))
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, p * (1 - p)


def loss(margin: np.ndarray, y: np.ndarray, classify: bool) -> float:
    if classify:
        return float(np.logaddexp(0.0, margin).sum() - margin @ y)
    return float(((margin - y) ** 2).sum())


def histograms(cells: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: int) -> np.ndarray:
    """Sums of gradient, curvature and rows by node, column and bin; ``cells`` holds column * BINS + bin."""
    width = cells.shape[1]
    flat = (cells + node[:, None] * (width * BINS)).ravel()
    size = nodes * width * BINS
    rows = np.bincount(flat, minlength=size).astype(float)
    curve = rows if (h == 1.0).all() else np.bincount(flat, np.repeat(h, width), size)
    return np.stack([np.bincount(flat, np.repeat(g, width), size), curve, rows]).reshape(3, nodes, width, BINS)


def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.square(np.maximum(np.abs(g) - L1, 0.0)) / (h + L2)


def best_splits(sums: np.ndarray, columns: np.ndarray) -> list[tuple]:
    """(feature, bin, gain, totals, left totals) of every node; feature -1 where no split gains."""
    left = np.cumsum(sums, axis=3)
    total, left = left[:, :, 0, -1], left[:, :, :, :-1]
    right = total[:, :, None, None] - left
    fine = (np.minimum(left[2], right[2]) >= MIN_LEAF) & (np.minimum(left[1], right[1]) >= MIN_HESSIAN)
    gain = score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1])[:, None, None]
    gain = np.where(fine, gain, -np.inf).reshape(total.shape[1], -1)
    best, out = np.argmax(gain, axis=1), []
    for node, at in enumerate(best.tolist()):
        f, b = divmod(at, BINS - 1)
        if gain[node, at] > 1e-12:
            out.append((int(columns[f]), b, float(gain[node, at]), *total[:, node].tolist(), *left[:, node, f, b].tolist()))
        else:
            out.append((-1, 0, 0.0, *total[:, node].tolist(), 0.0, 0.0, 0.0))
    return out


class Stopper:
    """Best round so far, and whether to go on."""

    def __init__(self, patience: int):
        self.patience, self.best, self.at = patience, np.inf, 0

    def better(self, value: float, rounds: int) -> bool:
        if value < self.best:
            self.best, self.at = value, rounds
            return True
        return False

    def done(self, rounds: int) -> bool:
        return rounds - self.at >= self.patience


# -- blocks ---------------------------------------------------------------------------


def scoped(rows: DataFrame) -> DataFrame:
    """Every row once in the pooled scope and once in its asset's."""
    return rows.withColumn("scope", F.explode(F.array(F.lit(POOLED), F.col("asset"))))


def cut_points(rows: DataFrame, width: int) -> DataFrame:
    """(fold, scope, n_train, cuts): quantiles of the training rows, column by column, end to end."""
    shares = [i / BINS for i in range(1, BINS)]
    found = [F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000) for i in range(width)]
    train = rows.filter("split = 'train' and y is not null")
    return train.groupBy("fold", "scope").agg(
        F.count(F.lit(1)).alias("n_train"), F.min("y").alias("low"), F.max("y").alias("high"), F.avg("y").alias("mean"), F.concat(*found).alias("cuts")
    )


def make_blocks(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """A row for each block of at most about BLOCK rows of one (fold, scope), its columns as bin numbers."""
    sizes = rows.groupBy("fold", "scope").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    key = F.xxhash64("asset", "date")
    left = rows.join(sizes, ["fold", "scope"]).withColumn("key", key).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    right = cuts.join(sizes, ["fold", "scope"]).select(
        F.col("fold").alias("of_fold"), F.col("scope").alias("of_scope"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"), "cuts"
    )

    def run(mine: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return pd.DataFrame(columns=_names(BLOCKS))
        mine = mine.sort_values("key")
        x = np.stack(mine["x"].to_numpy()).astype(float)
        bins = np.zeros(x.shape, np.uint8)
        if len(cut):
            for f, edges in enumerate(np.asarray(cut["cuts"].iloc[0], float).reshape(x.shape[1], -1)):
                bins[:, f] = np.searchsorted(np.unique(edges), x[:, f])
        first = mine.iloc[0]
        split = mine["split"].map({s: i for i, s in enumerate(SPLITS)}).to_numpy(np.int8)
        row = [first["fold"], first["scope"], first["part"], first["parts"], mine["asset"].tolist(), mine["date"].tolist()]
        row += [split.tobytes(), mine["y"].to_numpy(float).tobytes(), mine["key"].to_numpy(np.int64).tobytes(), bins.tobytes()]
        return pd.DataFrame([row], columns=_names(BLOCKS))

    grouped = left.groupBy("fold", "scope", "part").cogroup(right.groupBy("of_fold", "of_scope", "of_part"))
    return grouped.applyInPandas(run, BLOCKS)


class Block:
    def __init__(self, row):
        self.row = row
        self.split, self.y = np.frombuffer(row.split, np.int8), np.frombuffer(row.y)
        self.key = np.frombuffer(row.key, np.int64)
        self.bins = np.frombuffer(row.bins, np.uint8).reshape(len(self.y), -1)
        known = ~np.isnan(self.y)
        self.train, self.val, self.test = (self.split == 0) & known, (self.split == 1) & known, self.split == 2

    def cells(self) -> np.ndarray:
        return self.bins[self.train].astype(np.int64) + np.arange(self.bins.shape[1]) * BINS

    def forecasts(self, margin: np.ndarray | None, seed: int, classify: bool) -> pd.DataFrame:
        at = np.flatnonzero(self.test)
        out = pd.DataFrame({"asset": [self.row.asset[i] for i in at], "date": [self.row.date[i] for i in at], "y_true": self.y[at]})
        value = np.full(len(at), np.nan) if margin is None else margin[at]
        proba = 1 / (1 + np.exp(-value)) if classify else np.full(len(at), np.nan)
        pred = np.where(np.isnan(value), np.nan, proba >= 0.5) if classify else value
        return out.assign(fold=self.row.fold, scope=self.row.scope, seed=seed, pred=pred, proba=proba)


def _clean(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reindex(columns=_names(RESULT)).astype(object)
    return frame.where(frame.notna(), None)


def start(mean: float, classify: bool) -> float:
    return float(np.log(mean / (1 - mean))) if classify else float(mean)


# -- one block ------------------------------------------------------------------------


def boost(block: Block, seed: int, classify: bool, rounds: int, patience: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Margins of all rows, gains by column and the number of rounds kept, for a fit of one block."""
    y, width = block.y, block.bins.shape[1]
    cells, train = block.cells(), np.flatnonzero(block.train)
    bins = block.bins
    margin = np.full(len(y), start(float(y[train].mean()), classify))
    checks = block.val.any() and np.ptp(y[block.val]) > 0
    stop, best, gains, kept = Stopper(patience), margin.copy(), np.zeros(width), np.zeros(width)
    if checks:
        stop.better(loss(margin[block.val], y[block.val], classify), 0)
    for r in range(rounds):
        used = np.flatnonzero(sampled_rows(block.key[train], seed, r))
        columns = sampled_columns(width, seed, r)
        g, h = gradients(margin[train[used]], y[train[used]], classify)
        shift = BINS * (np.arange(len(columns)) - columns)
        some = cells[used][:, columns] + shift
        tree, node, mine = Tree(), np.zeros(len(used), np.int64), bins[train[used]]
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            here = node >= first
            if not here.any():
                break
            sums = histograms(some[here], g[here], h[here], node[here] - first, nodes)
            for k, split in enumerate(best_splits(sums, columns)):
                if split[5] > 0:
                    tree.take(first + k, split)
            node = tree.place(mine, depth + 1)
        tree.best_first()
        margin = margin + tree.value[tree.place(bins)]
        np.add.at(gains, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        if checks:
            if stop.better(loss(margin[block.val], y[block.val], classify), r + 1):
                best, kept = margin, gains.copy()
            if stop.done(r + 1):
                return best, kept, stop.at
        elif tree.feature[0] < 0:
            break
    return (best, kept, stop.at) if checks else (margin, gains, r + 1)


def small_fits(blocks: DataFrame, seeds: Sequence[int], classify: bool, rounds: int, patience: int, min_rows: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block, seed = Block(row), int(row.seed)
                if not fittable(int(block.train.sum()), row.scope, min_rows, classify and np.ptp(block.y[block.train]) == 0 if block.train.any() else True):
                    yield _clean(block.forecasts(None, seed, classify))
                    continue
                margin, gains, kept = boost(block, seed, classify, rounds, patience)
                told = pd.DataFrame({"fold": row.fold, "scope": row.scope, "seed": seed, "feature": np.arange(len(gains)), "gain": gains, "rounds": kept})
                yield _clean(pd.concat([block.forecasts(margin, seed, classify), told]))

    spread = blocks.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    n = max(1, spread.count())
    return spread.repartition(min(n, 4_096), "fold", "scope", "seed").mapInPandas(run, RESULT)


def fittable(n_train: int, scope: str, min_rows: int, constant: bool) -> bool:
    return n_train > 0 and not constant and (scope == POOLED or n_train >= min_rows)


# -- many blocks ----------------------------------------------------------------------


def _margins(block: Block, base: float, trees: list[Tree], held: bytes | None, from_round: int) -> np.ndarray:
    margin = np.full(len(block.y), base) if held is None else np.frombuffer(held)
    for tree in trees[from_round:]:
        margin = margin + tree.value[tree.place(block.bins)]
    return margin


def large_fits(
    blocks: DataFrame, means: dict[tuple[int, str], float], checked: set[tuple[int, str]], seeds: Sequence[int], classify: bool, width: int,
    rounds: int, patience: int,
) -> DataFrame:
    """Fits of several blocks: a job for each level, shared by all fits that still grow.

    ``means`` has the training mean of every (fold, scope) to fit, ``checked`` those whose validation rows can tell.  Tasks find margins from the trees so far; every REFRESH
    rounds margins are written next to the blocks.  The driver holds the trees.
    """
    fits = [(f, s, seed) for f, s in means for seed in seeds]
    base = {k: start(m, classify) for k, m in means.items()}
    trees: dict[tuple, list[Tree]] = {k: [] for k in fits}
    stops = {k: Stopper(patience) for k in fits}
    keys = blocks.sparkSession.createDataFrame([k for k in means] or [(-1, "")], "fold int, scope string")
    mine = blocks.join(F.broadcast(keys), ["fold", "scope"], "left_semi")
    open_, held, since = set(fits), mine.withColumn("margins", F.lit(None).cast("array<binary>")), 0
    place = {s: i for i, s in enumerate(seeds)}

    def level(depth: int, growing: dict[tuple, Tree], r: int) -> list:
        first, nodes = 2**depth - 1, 2**depth

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, list] = {}
            last = None
            for frame in frames:
                for row in frame.itertuples():
                    if last is not None and last[:2] != (row.fold, row.scope) and total:
                        yield out(total, last[2])  # blocks of a fit lie together, so few sums are held
                        total = {}
                    last = (row.fold, row.scope, int(row.part) % 64)
                    block = Block(row)
                    for seed in seeds:
                        key = (row.fold, row.scope, seed)
                        if key not in growing:
                            continue
                        margin = _margins(block, base[key[:2]], trees[key], None if row.margins is None else row.margins[place[seed]], since)
                        train = np.flatnonzero(block.train)
                        used = train[sampled_rows(block.key[train], seed, r)]
                        columns = sampled_columns(width, seed, r)
                        g, h = gradients(margin[used], block.y[used], classify)
                        node = growing[key].place(block.bins[used], depth)
                        here = node >= first
                        some = block.bins[np.ix_(used[here], columns)].astype(np.int64) + np.arange(len(columns)) * BINS
                        sums = histograms(some, g[here], h[here], node[here] - first, nodes)
                        scored = (loss(margin[block.val], block.y[block.val], classify), int(block.val.sum()))
                        held_sums = total.setdefault(key, [0.0, 0.0, 0])
                        total[key] = [held_sums[0] + sums, held_sums[1] + scored[0], held_sums[2] + scored[1]]
            if total:
                yield out(total, last[2])

        def out(total: dict, salt: int) -> pd.DataFrame:
            rows = [
                [*key, first + k, salt, sums[:, k].tobytes(), value if k == 0 else 0.0, seen if k == 0 else 0]
                for key, (sums, value, seen) in total.items() for k in range(nodes)
            ]
            return pd.DataFrame(rows, columns=_names(SUMS))

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            row = pdf.iloc[[0]].copy()
            row["sums"] = [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]
            return row.assign(loss=pdf["loss"].sum(), seen=pdf["seen"].sum())

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            sums = sum(np.frombuffer(s) for s in pdf["sums"]).reshape(3, 1, -1, BINS)
            key = pdf.iloc[0]
            split = best_splits(sums, sampled_columns(width, int(key["seed"]), r))[0]
            return pd.DataFrame([[key["fold"], key["scope"], key["seed"], key["node"], *split, pdf["loss"].sum(), pdf["seen"].sum()]], columns=_names(CHOSEN))

        told = held.mapInPandas(partial, SUMS).groupBy("fold", "scope", "seed", "node", "salt").applyInPandas(add, SUMS)
        return told.groupBy("fold", "scope", "seed", "node").applyInPandas(choose, CHOSEN).collect()

    for r in range(rounds + 1):
        growing = {k: Tree() for k in open_}
        for depth in range(DEPTH if r < rounds else 1):
            chosen = level(depth, growing, r)
            if depth == 0:  # the scores are those after the trees so far
                for c in chosen:
                    key = (c.fold, c.scope, c.seed)
                    if c.seen and key[:2] in checked:
                        stops[key].better(c.loss, r)
                        if stops[key].done(r):
                            open_.discard(key)
                growing = {k: t for k, t in growing.items() if k in open_}
            for c in chosen:
                key = (c.fold, c.scope, c.seed)
                if key in growing and c.n > 0:
                    growing[key].take(c.node, tuple(c)[4:13])
            if not growing:
                break
        if r == rounds or not open_:
            break
        for key, tree in growing.items():
            trees[key].append(tree.best_first())
            if stops[key].best == np.inf and tree.feature[0] < 0:
                open_.discard(key)
        if r + 1 - since >= REFRESH:
            now = r + 1

            def refresh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    frame["margins"] = [
                        [
                            _margins(Block(row), base[row.fold, row.scope], trees[row.fold, row.scope, s], None if row.margins is None else row.margins[place[s]], since).tobytes()
                            for s in seeds
                        ]
                        for row in frame.itertuples()
                    ]
                    yield frame

            held, since = cut_lineage(held.mapInPandas(refresh, BLOCKS + ", margins array<binary>")), now
    kept = {k: trees[k][: stops[k].at] if stops[k].best < np.inf else trees[k] for k in fits}

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = Block(row)
                for seed in seeds:
                    key = (row.fold, row.scope, seed)
                    margin = _margins(block, base[key[:2]], kept[key], None, 0) if key in kept else None
                    yield _clean(block.forecasts(margin, seed, classify))

    gains = []
    for (fold, scope, seed), mine in kept.items():
        sums = np.zeros(width)
        for t in mine:
            np.add.at(sums, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        gains += [(fold, scope, seed, None, None, None, None, None, i, float(v), len(mine)) for i, v in enumerate(sums)]
    return blocks.mapInPandas(score, RESULT).unionByName(blocks.sparkSession.createDataFrame(gains, RESULT))


# -- all fits -------------------------------------------------------------------------


def fit_predict(
    rows: DataFrame, columns: Sequence[str], model: str, target: str, seeds: Sequence[int] = range(5), classify: bool = True,
    rounds: int = ROUNDS, patience: int = PATIENCE, min_rows: int = MIN_TRAIN_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts of the test rows in both scopes, and gains (model, fold, scope, seed, feature, gain, rounds).

    An asset with too few training rows, and for classes a scope with one class only, gets NULL forecasts and no gains.
    """
    width, seeds = len(columns), list(seeds)
    many = cut_lineage(scoped(rows).select("fold", "scope", "split", "asset", "date", "x", "y"))
    cuts = cut_lineage(cut_points(many, width))
    blocks = cut_lineage(make_blocks(many, cuts).sortWithinPartitions("fold", "scope", "part"))
    found = small_fits(blocks.filter("parts = 1"), seeds, classify, rounds, patience, min_rows)
    large = blocks.filter("parts > 1")
    ids = large.select("fold", "scope").distinct()
    if not ids.isEmpty():
        # one row for each fit beyond a block, so at most the rows over BLOCK
        known = ids.join(cuts, ["fold", "scope"]).select("fold", "scope", "n_train", "mean", "low", "high").collect()
        means = {(r.fold, r.scope): r["mean"] for r in known if fittable(r.n_train, r.scope, min_rows, classify and r.low == r.high)}
        val = many.filter("split = 'val'").groupBy("fold", "scope").agg(F.min("y").alias("low"), F.max("y").alias("high"))
        checked = {(r.fold, r.scope) for r in val.filter("low < high").join(ids, ["fold", "scope"]).collect()}
        found = found.unionByName(large_fits(large, means, checked, seeds, classify, width, rounds, patience))
    found = cut_lineage(found)
    name = F.when(F.col("scope") == POOLED, F.lit(model)).otherwise(F.lit(model + SUFFIX))
    forecasts = found.filter("date is not null").select(
        "asset", "date", "pred", "proba", name.alias("model"), "fold", "seed", F.lit(target).alias("target"), "y_true"
    )
    labels = F.array(*[F.lit(c) for c in columns])
    gains = found.filter("feature is not null").select(
        name.alias("model"), "fold", "scope", "seed", F.get(labels, F.col("feature")).alias("feature"), "gain", "rounds"
    )
    return forecasts, gains
