"""Guarded aggregates: bias-corrected moments and correlations that never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.expr import SD_FLOOR, col, finite


def skew(c: Column | str) -> Column:
    c = col(c)
    n = F.count(c).cast("double")
    return finite(
        F.when(
            (n > 2) & (F.stddev_samp(c) > SD_FLOOR),
            F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2),
        )
    )


def kurt(c: Column | str) -> Column:
    c = col(c)
    n = F.count(c).cast("double")
    return finite(
        F.when(
            (n > 3) & (F.stddev_samp(c) > SD_FLOOR),
            (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6),
        )
    )


def corr(a: Column | str, b: Column | str) -> Column:
    """Pairwise-complete correlation; NULL when either side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    sx, sy = F.stddev_samp(x), F.stddev_samp(y)
    return finite(
        F.when((sx > SD_FLOOR) & (sy > SD_FLOOR), F.covar_samp(x, y) / (sx * sy))
    )
