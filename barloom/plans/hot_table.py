"""The wide table of the most recent trade dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import factorset


def recent_dates(bars: DataFrame, n: int) -> DataFrame:
    """The last n trade dates, ascending; days collapse before they are sorted."""
    return bars.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n).orderBy("trade_date")


def retain(rows: DataFrame, recent: DataFrame) -> DataFrame:
    """Rows from the oldest recent date on."""
    return rows.where(F.col("trade_date") >= recent.agg(F.min("trade_date")).scalar())


def build(long: DataFrame, bars: DataFrame, names: list[str], n: int) -> DataFrame:
    """Every factor of the recent dates side by side; NaN is stored as null."""
    recent = recent_dates(bars, n)
    rows = retain(long, recent).join(recent, "trade_date", "left_semi")
    clean = F.when(~F.isnan("value"), F.col("value"))
    return factorset.wide(rows.withColumn("value", clean), names)
