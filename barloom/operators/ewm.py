"""Recursive smoothing as an affine prefix scan.

A row is the map y -> a x + (1 - a) y. Rows of a code are cut into blocks by the number of their values; inside a block the
maps compose to one running sum, scaled by the powers of 1 - a, and a block hands its last value on. Blocks are so long that
what they would hand on beyond the next one is below 1e-40 of it, and short enough that the scaling stays within doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the powers of the decay within a block go down to 1e-40.
_REACH = 40 * math.log(10)


def sma(df: DataFrame, x: str, n: int, m: int = 1, out: str = "sma") -> DataFrame:
    """y[t] = a*x[t] + (1-a)*y[t-1] with a = m/n per code, from the first value on; a null x gives null and leaves the state
    as it is. Returns ts_code, trade_date, x and `out`."""
    a = float(m) / float(n)
    if not 0 < a <= 1:
        raise ValueError(f"no smoothing factor: {m}/{n}")
    rest = 1.0 - a
    slim = df.select("ts_code", "trade_date", x)
    if not rest:
        return slim.withColumn(out, F.col(x).cast("double"))
    block = max(1, math.ceil(_REACH / -math.log(rest)))
    by_code = Window.partitionBy("ts_code").orderBy("trade_date")
    so_far = by_code.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value, c = F.col(x).cast("double"), F.col("_c")
    counted = slim.withColumn("_c", F.count(x).over(so_far)).withColumns({"_b": F.floor((c - 1) / block), "_p": (c - 1) % block})
    share = F.when(c == 1, value).otherwise(value * a)
    inside = Window.partitionBy("ts_code", "_b").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    power = lambda e: F.pow(F.lit(rest), e)
    local = power(F.col("_p")) * F.sum(share * power(-F.col("_p"))).over(inside)
    scanned = counted.withColumn("_y", F.when(F.col(x).isNotNull(), local))
    before = by_code.rowsBetween(Window.unboundedPreceding, -1)
    handed = F.last(F.when(F.col("_p") == block - 1, F.col("_y")), ignorenulls=True).over(before)
    smoothed = F.col("_y") + F.when(F.col("_b") > 0, power(F.col("_p") + 1) * handed).otherwise(0.0)
    return scanned.withColumn(out, smoothed).drop("_c", "_b", "_p", "_y")
