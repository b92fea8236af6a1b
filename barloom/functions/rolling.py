"""Trailing-window functions over one code's bars: `(Column, d, window) -> Column`.

All of them use the same two window specifications, so Spark puts every call of one select into a single
window stage: one shuffle on ts_code and one sort. A window partition holds the bars of one code, at most one
per trading day.

Null rule: a window yields a value only when it is full of non-null values, and nothing yields NaN or infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.stats import pearson, slope


def by_code() -> WindowSpec:
    return Window.partitionBy("ts_code").orderBy("trade_date")


def trailing(d: int, w: WindowSpec | None = None) -> WindowSpec:
    """The last d rows, this one included."""
    if d < 1:
        raise ValueError(f"window must be positive: {d}")
    return (w or by_code()).rowsBetween(-(d - 1), 0)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _full(value: Column, x: Column, d: int, w: WindowSpec | None) -> Column:
    return F.when(F.count(x).over(trailing(d, w)) == d, value)


def delay(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    return F.lag(x, d).over(w or by_code())


def delta(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    return x - delay(x, d, w)


def ts_sum(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    return _full(F.sum(x).over(trailing(d, w)), x, d, w)


def ts_mean(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    return _full(F.avg(x).over(trailing(d, w)), x, d, w)


def ts_std(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Sample standard deviation."""
    return _full(F.stddev_samp(x).over(trailing(d, w)), x, d, w)


def ts_max(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    return _full(F.max(x).over(trailing(d, w)), x, d, w)


def ts_min(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    return _full(F.min(x).over(trailing(d, w)), x, d, w)


def wma(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Weights d..1 from newest to oldest. Missing lags count as 0 under the full divisor, so the first d-1
    rows are not null."""
    if d <= 1:
        return x
    total = F.lit(0.0)
    for k in range(d):
        total = total + F.coalesce(x if k == 0 else delay(x, k, w), F.lit(0.0)) * float(d - k)
    return total / float(d * (d + 1) / 2)


decay_linear = wma


def ts_rank(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Share of the window's values that are at most the current one; needs d rows, not d values."""
    t = trailing(d, w)
    at_most = F.size(F.filter(F.collect_list(x).over(t), lambda v: v <= x))
    share = F.try_divide(at_most, F.count(x).over(t))
    return F.when((F.count(F.lit(1)).over(t) == d) & x.isNotNull(), share)


def _pair(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), 1)


def ts_corr(x: Column, y: Column, d: int = 6, w: WindowSpec | None = None) -> Column:
    """Pearson correlation; null where a side does not vary."""
    t = trailing(d, w)
    return F.when(F.count(_pair(x, y)).over(t) == d, pearson(x, y, lambda c: c.over(t)))


def ts_cov(x: Column, y: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Sample covariance."""
    return _full(F.covar_samp(x, y).over(trailing(d, w)), _pair(x, y), d, w)


def ts_count(cond: Column, d: int, w: WindowSpec | None = None) -> Column:
    return ts_sum(cond.cast("double"), d, w)


def ts_sumif(x: Column, d: int, cond: Column, w: WindowSpec | None = None) -> Column:
    """Sum of x where cond holds; a null condition counts as false."""
    return ts_sum(F.when(cond, x).otherwise(F.lit(0.0)), d, w)


def _days_since(x: Column, d: int, w: WindowSpec | None, extreme) -> Column:
    t = trailing(d, w)
    pos = F.array_position(F.collect_list(x).over(t), extreme(x).over(t))
    return _full((F.lit(d) - pos).cast("double"), x, d, w)


def high_day(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Bars since the first maximum of the window."""
    return _days_since(x, d, w, F.max)


def low_day(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Bars since the first minimum of the window."""
    return _days_since(x, d, w, F.min)


def reg_beta(y: Column, x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Least-squares slope of y on x over the pairs in the last d rows; at least max(3, d // 2) pairs."""
    t = trailing(d, w)
    p = _pair(x, y)
    enough = (F.count(F.lit(1)).over(t) == d) & (F.count(p).over(t) >= max(3, d // 2))
    return F.when(enough, slope(y, x, lambda c: c.over(t)))


def reg_beta_seq(y: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Slope of y on 1..d over a full window: a fixed weighting of the lags."""
    mean = (d + 1) / 2.0
    var = d * (d * d - 1) / 12.0 or 1.0
    total = F.lit(0.0)
    for k in range(d):
        total = total + (y if k == 0 else delay(y, k, w)) * (d - k - mean)
    return _full(total / var, y, d, w)


def ts_prod(x: Column, d: int, w: WindowSpec | None = None) -> Column:
    """Product of a full window of non-negative values: 0 with any zero, null with any negative."""
    t = trailing(d, w)
    low = F.min(x).over(t)
    return _full(
        F.when(low < 0, F.lit(None).cast("double")).when(low == 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(x)).over(t))),
        x,
        d,
        w,
    )


def sum_ac(x: Column, d: int | None = None, w: WindowSpec | None = None) -> Column:
    """Running sum of a code, or the d-row sum."""
    if d is not None:
        return ts_sum(x, d, w)
    run = (w or by_code()).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(x.isNotNull(), F.sum(x).over(run))


def simple_return(close: Column, d: int = 1, w: WindowSpec | None = None) -> Column:
    return F.try_divide(close, delay(close, d, w)) - 1.0


def momentum(close: Column, d: int = 20, w: WindowSpec | None = None) -> Column:
    return simple_return(close, d, w)


def volatility(ret: Column, d: int = 60, min_rows: int = 30, w: WindowSpec | None = None) -> Column:
    """Sample standard deviation of the returns in the last d rows, with at least min_rows of them."""
    t = trailing(d, w)
    return F.when(F.count(ret).over(t) >= min_rows, F.stddev_samp(ret).over(t))
