"""Several factors side by side: from the long table to one column per factor, for all dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["ts_code", "trade_date"]


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column per factor name (null where absent): the full outer merge of the series, by one aggregate with a
    fixed name list."""
    return long.where(F.col("factor_name").isin(names)).groupBy(*KEYS).pivot("factor_name", names).agg(F.first("value"))


def cross_section(long: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the first factor, the others attached."""
    return wide(long, names).where(F.col(names[0]).isNotNull())


def long(df: DataFrame, names: list[str]) -> DataFrame:
    """Back to one row per factor value; nulls go."""
    return df.unpivot(KEYS, names, "factor_name", "value").where(F.col("value").isNotNull())


def attach_benchmark(panel: DataFrame, index_daily: DataFrame | None, benchmark: str) -> DataFrame:
    """Benchmark open and close by date; null columns without an index table."""
    if index_daily is None:
        nothing = F.lit(None).cast("double")
        return panel.withColumns({"benchmark_open": nothing, "benchmark_close": nothing})

    bm = index_daily.where(F.col("ts_code") == benchmark).select(
        "trade_date", F.col("open").alias("benchmark_open"), F.col("close").alias("benchmark_close")
    )
    return panel.join(bm, "trade_date", "left")
