"""Measures of return series: one row per day and series, so a window partition is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.session import stage

DAYS_PER_YEAR = 252


def _run(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def nav(df: DataFrame, ret: str, by: list[str] | None = None) -> DataFrame:
    """Running product of 1 + return; days without a return are left out."""
    return df.where(F.col(ret).isNotNull()).withColumn("nav", F.product(F.lit(1.0) + F.col(ret)).over(_run(by or [])))


def return_metrics(df: DataFrame, ret: str, by: list[str] | None = None) -> DataFrame:
    """annual_return, sharpe, mdd, calmar and n_days of each series.

    The peak starts at 1; sharpe needs a spread, calmar a drawdown.
    """
    by = by or []
    run = _run(by)
    wealth = nav(df, ret, by).withColumn("_peak", F.greatest(F.lit(1.0), F.max("nav").over(run)))
    n, total = F.col("n_days"), F.col("_total")
    agg = wealth.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.product(F.lit(1.0) + F.col(ret)).alias("_total"),
        F.avg(ret).alias("_mean"),
        F.stddev_samp(ret).alias("_std"),
        F.least(F.lit(0.0), F.min(F.col("nav") / F.col("_peak") - 1.0)).alias("mdd"),
    )
    out = agg.where(n > 0).select(
        *by,
        "n_days",
        (F.pow(F.when(total >= 0, total), F.lit(float(DAYS_PER_YEAR)) / n) - 1.0).alias("annual_return"),
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * F.sqrt(F.lit(float(DAYS_PER_YEAR)))).alias("sharpe"),
        "mdd",
    )
    return out.withColumn("calmar", F.when(F.col("mdd") < 0, F.col("annual_return") / F.abs("mdd")))


def group_totals(wide: DataFrame, groups: list[str]) -> DataFrame:
    """Final NAV and total return of every group column of a wide daily frame."""
    long = wide.unpivot(["trade_date"], groups, "group_id", "r")
    return (
        long.groupBy("group_id")
        .agg(F.product(F.lit(1.0) + F.col("r")).alias("final_nav"))
        .withColumn("total_return", F.col("final_nav") - 1.0)
    )


def benchmark_nav(dates: DataFrame, closes: DataFrame) -> DataFrame:
    """NAV of the index on the given dates: forward-filled close over the base.

    The base is the last close on or before the first date, else the first close among the dates. Both inputs are a row a
    day and are read several times, so they are staged.
    """
    dates = stage(dates.select("trade_date"))
    usable = stage(closes.where(F.col("close").isNotNull() & (F.col("close") != 0)).select("trade_date", "close"))
    first = dates.agg(F.min("trade_date")).scalar()
    prior = usable.where(F.col("trade_date") <= first).agg(F.max_by("close", "trade_date")).scalar()
    later = usable.join(dates.select("trade_date"), "trade_date", "left_semi").agg(F.min_by("close", "trade_date")).scalar()
    joined = dates.select("trade_date").join(usable, "trade_date", "left")
    filled = joined.withColumn("_base", F.coalesce(prior, later)).where(F.col("_base").isNotNull())
    last = F.last("close", ignorenulls=True).over(_run([]))
    return filled.select("trade_date", (F.coalesce(last, F.col("_base")) / F.col("_base")).alias("value"))


def excess_nav(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Strategy NAV over benchmark NAV on the common dates; a zero benchmark drops the day."""
    b = benchmark.where(F.col("value") != 0).select("trade_date", F.col("value").alias("_b"))
    return strategy.join(b, "trade_date").select("trade_date", (F.col("value") / F.col("_b")).alias("value"))
