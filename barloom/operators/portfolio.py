"""Weights, holdings changes, turnover and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import CostRates, group_cost, trade_cost
from barloom.operators import ordering


def with_group_id(df: DataFrame) -> DataFrame:
    return df.withColumn("group_id", F.concat(F.lit("G"), F.col("group_no").cast("string")))


def renormalise(weights: DataFrame, by: tuple[str, ...] = ("trade_date", "group_id")) -> DataFrame:
    """Weights over the sum of their absolute values per group; zero weights go."""
    kept = weights.where(F.abs("weight") > 0)
    scaled = ordering.with_group_stats(kept, list(by), {"_s": F.sum(F.abs("weight"))})
    return scaled.withColumn("weight", F.col("weight") / F.col("_s")).drop("_s")


def holdings_delta(holdings: DataFrame, rates: CostRates = CostRates()) -> DataFrame:
    """Trades between consecutive rebalances: current against previous weight of every group and code.

    holdings: rebalance_no, group_id, ts_code, weight. A code without a current weight was sold; what was held
    before a rebalance is what the one numbered just before it holds. Changes below 1e-12 are none.
    """
    none, keys = F.lit(0.0), ("group_id", "ts_code")
    now = holdings.select("rebalance_no", *keys, F.col("weight").alias("_now"), none.alias("_before"))
    before = holdings.select((F.col("rebalance_no") + 1).alias("rebalance_no"), *keys, none.alias("_now"), F.col("weight").alias("_before"))
    d = now.unionByName(before).groupBy("rebalance_no", *keys).agg((F.sum("_now") - F.sum("_before")).alias("delta_weight"))
    return d.where(F.abs("delta_weight") >= 1e-12).select(
        "rebalance_no", "group_id", "ts_code", "delta_weight", trade_cost(F.col("delta_weight"), rates).alias("cost")
    )


def turnover_by_group(trades: DataFrame, rates: CostRates = CostRates()) -> DataFrame:
    """Buys, sells, turnover and cost of every group and rebalance."""
    dw = F.col("delta_weight")
    t = trades.groupBy("rebalance_no", "group_id").agg(
        F.sum(F.when(dw > 0, dw).otherwise(0.0)).alias("buys"), F.sum(F.when(dw < 0, -dw).otherwise(0.0)).alias("sells")
    )
    return t.withColumns(
        {"turnover": F.col("buys") + F.col("sells"), "cost": group_cost(F.col("buys"), F.col("sells"), rates)}
    )


def average_turnover(by_group: DataFrame, n_groups: int) -> DataFrame:
    """Turnover of each rebalance, the mean over all groups (a group without trades counts 0)."""
    return by_group.groupBy("rebalance_no").agg((F.sum("turnover") / n_groups).alias("turnover"))
