"""Cross-section scores, listings and information coefficients, for all dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.stats import pearson
from barloom.operators import ordering


def _zscore(x: str) -> Column:
    """z of x by its date's stats; 0 where the date has no spread, null where x is null."""
    std = F.col(f"_s_{x}")
    z = F.when(std.isNotNull() & ~F.isnan(std) & (std > 0), (F.col(x) - F.col(f"_m_{x}")) / std).otherwise(F.lit(0.0))
    return F.when(F.col(x).isNotNull(), z)


def composite(df: DataFrame, weights: dict[str, float], by: str = "trade_date") -> DataFrame:
    """Weighted mean of z-scores over the factors present in a row; rows with none of them are left out.

    The stats take every row of `df`; restrict to a universe afterwards.
    """
    aggs = {f"_m_{c}": F.avg(c) for c in weights} | {f"_s_{c}": F.stddev_samp(c) for c in weights}
    scored = ordering.with_group_stats(df, [by], aggs)
    total, used = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        z = _zscore(c)
        total = total + F.coalesce(z * w, F.lit(0.0))
        used = used + F.when(z.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    out = scored.withColumn("value", F.when(used > 0, total / used))
    return out.drop(*aggs).where(F.col("value").isNotNull())


def ranked(df: DataFrame, value: str, by: str = "trade_date", tie: str = "ts_code") -> DataFrame:
    """Rows with a value, positions 1..n by descending value."""
    present = df.where(F.col(value).isNotNull())
    return ordering.positions(present, [by], [-F.col(value), F.col(tie)])


def information_coefficient(pairs: DataFrame, factor: str, fwd: str, by: str = "trade_date", rank: bool = True) -> DataFrame:
    """Per date the Pearson and the rank correlation of factor and forward return.

    Null with fewer than 3 pairs or a side that does not vary.
    """
    ok = pairs.where(F.col(factor).isNotNull() & F.col(fwd).isNotNull()).select(by, factor, fwd)

    def corr(x: str, y: str) -> Column:
        return F.when(F.count(F.lit(1)) >= 3, pearson(F.col(x), F.col(y)))

    if not rank:
        return ok.groupBy(by).agg(corr(factor, fwd).alias("ic"))
    placed = ordering.average_rank(ok, factor, [by], "_rf")
    placed = ordering.average_rank(placed, fwd, [by], "_rr")
    return placed.groupBy(by).agg(corr(factor, fwd).alias("ic"), corr("_rf", "_rr").alias("rank_ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """Means and mean over sample deviation; the ratio needs two dates and a spread."""

    def ratio(c: str) -> Column:
        return F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c))

    return ic.agg(
        F.avg("ic").alias("ic_mean"),
        F.avg("rank_ic").alias("rank_ic_mean"),
        ratio("ic").alias("icir"),
        ratio("rank_ic").alias("rank_icir"),
    )
