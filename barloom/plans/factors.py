"""Factors as plug-ins, and the job that computes one for a month."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as ts


@dataclass(frozen=True)
class FactorMeta:
    name: str
    window: int
    category: str = "技术"
    version: str = "1"
    display_name: str = ""
    params: tuple[tuple[str, object], ...] = ()


class Factor(Protocol):
    """A factor reads adjusted bars and returns ts_code, trade_date, value."""

    def meta(self) -> FactorMeta: ...

    def compute(self, bars: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Momentum:
    window: int = 20

    def meta(self) -> FactorMeta:
        return FactorMeta(f"momentum_{self.window}", self.window)

    def compute(self, bars: DataFrame) -> DataFrame:
        value = ts.momentum(F.col("close_adj"), self.window)
        return bars.select("ts_code", "trade_date", value.alias("value")).where(F.col("value").isNotNull())


@dataclass(frozen=True)
class Volatility:
    window: int = 60
    min_rows: int = 30

    def meta(self) -> FactorMeta:
        return FactorMeta(f"volatility_{self.window}", self.window)

    def compute(self, bars: DataFrame) -> DataFrame:
        rets = bars.select("ts_code", "trade_date", ts.simple_return(F.col("close_adj")).alias("_r"))
        value = ts.volatility(F.col("_r"), self.window, self.min_rows)
        return rets.select("ts_code", "trade_date", value.alias("value")).where(F.col("value").isNotNull())


def compute_month(factor: Factor, store, month: str) -> DataFrame:
    """Factor rows of one month: bars with the factor's look-back, computed and trimmed; the sink orders them."""
    bars = store.read_month_with_window(month, factor.meta().window)
    rows = factor.compute(bars).where(F.substring("trade_date", 1, 6) == month)
    return rows.select(F.lit(factor.meta().name).alias("factor_name"), "ts_code", "trade_date", "value")


def months_to_compute(available: DataFrame, existing: DataFrame, start: str | None = None, end: str | None = None, force: bool = False) -> DataFrame:
    """Months with bars, within bounds, that the factor has no partition for; all of them when forced."""
    months = available.select("dt")
    if start:
        months = months.where(F.col("dt") >= start)
    if end:
        months = months.where(F.col("dt") <= end)
    return months if force else months.join(existing.select("dt"), "dt", "left_anti")


def refresh_meta(stored: DataFrame, registered: DataFrame, coverage: DataFrame) -> DataFrame:
    """Factor metadata after a refresh: registered factors with their coverage; a formula edited in the stored
    metadata is kept, factors that are only stored stay.

    stored and registered: factor_name, display_name, source, category, formula.
    """
    from barloom.operators.merge import upsert

    kept = stored.select("factor_name", F.col("formula").alias("_edited"))
    text = F.when(F.coalesce(F.col("_edited"), F.lit("")) != "", F.col("_edited")).otherwise(F.col("formula"))
    fresh = registered.join(kept, "factor_name", "left").withColumn("formula", text).drop("_edited")
    fresh = fresh.join(coverage, "factor_name", "left").withColumn("month_count", F.coalesce("month_count", F.lit(0)).cast("bigint"))
    return upsert(stored, fresh, ["factor_name"])


def wide_days_to_load(opens: DataFrame, stored: DataFrame, current_month: str) -> DataFrame:
    """Days of a vendor's wide frame to load: open days not stored yet, and all of the current month."""
    missing = opens.join(stored.select("trade_date").distinct(), "trade_date", "left_anti")
    return missing.union(opens.where(F.substring("trade_date", 1, 6) == current_month)).distinct()
