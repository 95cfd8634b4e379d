"""Row-positional windows over one ordered series per key.

Every statistic of a series shares one ``Window`` spec, so Catalyst plans a single
exchange and sort however many of them are stacked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barloom.functions.expr import SD_FLOOR, col, finite, sd_ratio


class Series:
    """Lags and trailing-row statistics within ``keys`` ordered by ``order``."""

    def __init__(self, keys: Sequence[str] = ("asset",), order: Sequence[str] = ("date",)):
        self.keys = tuple(keys)
        self.order = tuple(order)

    @property
    def spec(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    # -- frames ---------------------------------------------------------------
    def frame(self, n: int):
        return self.spec.rowsBetween(-(n - 1), 0)

    @property
    def running(self):
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    # -- offsets --------------------------------------------------------------
    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(col(c), k).over(self.spec)

    def lead(self, c: Column | str, k: int = 1) -> Column:
        return F.lead(col(c), k).over(self.spec)

    def diff(self, c: Column | str, k: int = 1) -> Column:
        return col(c) - self.lag(c, k)

    def fill_forward(self, c: Column | str) -> Column:
        return F.last(col(c), ignorenulls=True).over(self.running)

    def number(self) -> Column:
        return F.row_number().over(self.spec) - 1

    def cumsum(self, c: Column | str) -> Column:
        return F.sum(col(c)).over(self.running)

    # -- rolling --------------------------------------------------------------
    def roll(
        self,
        fn: Callable[[Column], Column],
        c: Column | str,
        n: int,
        min_periods: int | None = None,
    ) -> Column:
        """``fn`` over the last ``n`` rows, NULL until enough of them are non-null."""
        c, frame = col(c), self.frame(n)
        return F.when(F.count(c).over(frame) >= (min_periods or n), fn(c).over(frame))

    def mean(self, c, n, min_periods=None) -> Column:
        return self.roll(F.avg, c, n, min_periods)

    def sum(self, c, n, min_periods=None) -> Column:
        return self.roll(F.sum, c, n, min_periods)

    def std(self, c, n, min_periods=None) -> Column:
        return self.roll(F.stddev_samp, c, n, min_periods)

    def min(self, c, n, min_periods=None) -> Column:
        return self.roll(F.min, c, n, min_periods)

    def max(self, c, n, min_periods=None) -> Column:
        return self.roll(F.max, c, n, min_periods)

    def median(self, c, n: int) -> Column:
        """Median of a full window (sorted copies of at most ``n`` values)."""
        c, frame = col(c), self.frame(n)
        values = F.sort_array(F.collect_list(c).over(frame))
        mid = (F.get(values, (n - 1) // 2) + F.get(values, n // 2)) / 2
        return F.when(F.count(c).over(frame) >= n, mid)

    def zscore(self, c, n, min_periods=None) -> Column:
        return sd_ratio(
            col(c) - self.mean(c, n, min_periods), self.std(c, n, min_periods)
        )

    def corr(self, a, b, n: int, min_periods: int | None = None) -> Column:
        """Rolling correlation over rows where both sides are present."""
        frame = self.frame(n)
        both = col(a).isNotNull() & col(b).isNotNull()
        x, y = F.when(both, col(a)), F.when(both, col(b))
        sx, sy = F.stddev_samp(x).over(frame), F.stddev_samp(y).over(frame)
        return finite(
            F.when(
                (F.count(x).over(frame) >= (min_periods or n))
                & (sx > SD_FLOOR)
                & (sy > SD_FLOOR),
                F.covar_samp(x, y).over(frame) / (sx * sy),
            )
        )
