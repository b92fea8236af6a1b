"""What a stored backtest run shows: totals, years, NAV curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import series


def yearly(returns: DataFrame) -> DataFrame:
    return series.return_metrics(returns.withColumn("year", F.substring("trade_date", 1, 4)), "long_short", ["year"])


def nav_curves(returns: DataFrame, groups: list[str], closes: DataFrame) -> DataFrame:
    """(curve, trade_date, value) of long-short, top and bottom group, benchmark, and long-short over benchmark."""

    def curve(name: str, col: str) -> DataFrame:
        return series.nav(returns.select("trade_date", F.col(col).alias("r")), "r").select(
            F.lit(name).alias("curve"), "trade_date", F.col("nav").alias("value")
        )

    named = lambda df, name: df.select(F.lit(name).alias("curve"), "trade_date", "value")
    ls = curve("long_short", "long_short")
    bm = series.benchmark_nav(returns.select("trade_date"), closes)
    parts = [
        ls,
        curve("top", groups[0]),
        curve("bottom", groups[-1]),
        named(bm, "benchmark"),
        named(series.excess_nav(ls.select("trade_date", "value"), bm), "excess"),
    ]
    return reduce(DataFrame.unionByName, parts)
