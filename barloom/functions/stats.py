"""Correlation and slope that are null, not an error, where a side does not vary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _same(c: Column) -> Column:
    return c


def pearson(x: Column, y: Column, over: Callable[[Column], Column] = _same) -> Column:
    """Pearson correlation of the pairs without nulls; `over` places each aggregate on a window."""
    pair = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(pair, x), F.when(pair, y)
    spread = over(F.stddev_samp(xs)) * over(F.stddev_samp(ys))
    return F.try_divide(over(F.covar_samp(xs, ys)), spread)


def slope(y: Column, x: Column, over: Callable[[Column], Column] = _same) -> Column:
    """Least-squares slope of y on x over the pairs without nulls."""
    pair = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(pair, x), F.when(pair, y)
    return F.try_divide(over(F.covar_pop(ys, xs)), over(F.var_pop(xs)))
