"""Normal distribution as plain column expressions (Spark has no ``erf``).

Hart's rational approximation of the normal tail, and beyond about seven standard
deviations the continued fraction of the tail.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.expr import col

# Published coefficients of Hart's approximation (1968, no. 5666),
# highest power first.
NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
SPLIT = 7.07106781186547
ROOT_TWO_PI = math.sqrt(2 * math.pi)
# Levels of the continued fraction beyond the split.
TAIL_TERMS = 12


def _horner(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf(c: Column | str) -> Column:
    """P(Z <= c) for a standard normal Z."""
    c = col(c)
    # Beyond 37 standard deviations the tail is zero in double precision.
    z = F.least(F.abs(c), F.lit(37.0))
    density = F.exp(-z * z / 2)
    near = density * _horner(z, NUMERATOR) / _horner(z, DENOMINATOR)
    fraction = z
    for k in range(TAIL_TERMS, 0, -1):
        fraction = z + F.lit(float(k)) / fraction
    tail = F.when(z < SPLIT, near).otherwise(density / fraction / ROOT_TWO_PI)
    return F.when(c.isNotNull(), F.when(c > 0, 1 - tail).otherwise(tail))


def normal_pdf(c: Column | str, mean: Column, sd: Column) -> Column:
    z = (col(c) - mean) / sd
    return F.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))
