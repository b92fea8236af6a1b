"""Weighted trailing windows from prefix moments: plan and time do not depend on the window's length.

Rows of a code are cut into blocks of d. With S and M the running sums of x and of p x within a block (p: the row's place in
its block), the last d rows are the block so far and what the block before has behind the same place: its whole sum less its
running sum there, d rows ago. Any weights that are linear in the lag follow from S and M. Sums begin anew in each block, so
differences lose no digits however long the code is. There is one shuffle, and a sort or two for each distinct d.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weighted:
    """A column `out` of column `x` over the last d rows: `wma` (weights d..1 from newest to oldest, missing values as 0 under
    the full divisor), `slope` (least squares on 1..d), `sum` or `mean` (these three need all d values)."""

    out: str
    kind: str
    x: str
    d: int

    def __post_init__(self):
        if self.kind not in ("wma", "slope", "sum", "mean"):
            raise ValueError(f"unknown kind: {self.kind}")
        if self.d < 1:
            raise ValueError(f"window must be positive: {self.d}")

    def value(self, count: Column, s: Column, m: Column) -> Column:
        """From the window's count, sum, and sum with weights 1..d, oldest first."""
        d, whole = self.d, count == self.d
        if self.kind == "wma":
            return m / (d * (d + 1) / 2.0)
        if self.kind == "slope":
            return F.when(whole, (m - s * ((d + 1) / 2.0)) / (d * (d * d - 1) / 12.0 or 1.0))
        return F.when(whole, s if self.kind == "sum" else s / d)


def weighted(df: DataFrame, wanted: list[Weighted], by: str = "ts_code", order: str = "trade_date") -> DataFrame:
    """`df` with the wanted columns. Windows of one length share their blocks, those over one x its sums."""
    at = Window.partitionBy(by).orderBy(order)
    out = df.withColumn("_t", F.row_number().over(at) - 1)
    for d in sorted({w.d for w in wanted}):
        out = _of_length(out, [w for w in wanted if w.d == d], d, by, order)
    return out.select(*df.columns, *[w.out for w in wanted])


def _of_length(df: DataFrame, wanted: list[Weighted], d: int, by: str, order: str) -> DataFrame:
    xs = sorted({w.x for w in wanted})
    p = F.col("_t") % d
    placed = df.withColumn("_b", F.floor(F.col("_t") / d))
    inside = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {}
    for i, x in enumerate(xs):
        value = F.coalesce(F.col(x).cast("double"), F.lit(0.0))
        sums |= {f"_c{i}": F.count(x).over(inside), f"_s{i}": F.sum(value).over(inside), f"_m{i}": F.sum(value * p).over(inside)}
    summed = placed.withColumns(sums)
    at = Window.partitionBy(by).orderBy(order)
    before = at.rowsBetween(Window.unboundedPreceding, -1)

    def behind(c: str) -> Column:
        """What the block before has behind this place."""
        whole = F.last(F.when(p == d - 1, F.col(c)), ignorenulls=True).over(before)
        return F.coalesce(whole - F.lag(c, d).over(at), F.lit(0))

    out = {}
    for w in wanted:
        c, s, m = (f"_{k}{xs.index(w.x)}" for k in "csm")
        weighted_ = (F.col(m) + (d - p) * F.col(s)) + (behind(m) - p * behind(s))
        out[w.out] = w.value(F.col(c) + behind(c), F.col(s) + behind(s), weighted_)
    return summed.withColumns(out).drop("_b", *sums)
