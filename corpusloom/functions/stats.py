"""Test statistics as Column expressions; p-values need erf, which Spark lacks, so these are pandas UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erf(s: pd.Series) -> pd.Series:
    return s.map(math.erf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def erfc(s: pd.Series) -> pd.Series:
    return s.map(math.erfc, na_action="ignore")


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def mcnemar_statistic(b: Column, c: Column) -> Column:
    """Chi square with continuity correction; 0 without discordant pairs."""
    return F.when(b + c == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2.0)) / (b + c))


def mcnemar_p(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, 1.0).otherwise(erfc(F.sqrt(mcnemar_statistic(b, c) / 2)))


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled z statistic; null where it is undefined."""
    pooled = (x1 + x2) / (n1 + n2)
    error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when(error > 0, (x1 / n1 - x2 / n2) / error)


def two_proportion_p(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    z = two_proportion_z(x1, n1, x2, n2)
    return F.coalesce(F.lit(1.0) - erf(F.abs(z) / math.sqrt(2)), F.lit(1.0))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """The value at index round(p * (n - 1)), halves to even, of a sorted array."""
    return F.element_at(sorted_values, F.bround(F.lit(p) * (F.size(sorted_values) - 1)).cast("int") + 1)


def share_text(share: Column) -> Column:
    """A share from 0 to 1 with two digits, rounded by its exact binary value, ties to even; format_string rounds the
    shortest decimal up instead, and so gives 0.155, which is a little less, as 0.16."""
    one = F.lit(1 << 62).cast("decimal(20,0)")
    exact = (share * F.lit(2.0**62)).cast("long").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    rest = exact % one
    whole = ((exact - rest) / one).cast("int")
    up = (rest * 2 > one) | ((rest * 2 == one) & (whole % 2 == 1))
    digits = whole + up.cast("int")
    return F.format_string("%d.%02d", F.floor(digits / 100), digits % 100)
