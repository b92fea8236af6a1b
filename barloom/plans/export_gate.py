"""Export of bars to the month-partitioned store, month by month behind a completeness gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: share of the expected bars that every past open day must reach.
PER_DAY_THRESHOLD = 0.99


def gate(per_day: DataFrame, exported: DataFrame, today: str, start: str, end: str) -> DataFrame:
    """(month, short_days, decision) of the months to look at: those not exported, and the current one.

    per_day: trade_date, n, expected for every open day. A past month with a short day is skipped, the current one is
    written with a warning and judged on its past days only; a month without open days does not appear.
    """
    current = today[:6]
    days = per_day.withColumn("month", F.substring("trade_date", 1, 6)).where(F.col("month").between(start, end))
    judged = (F.col("month") != current) | (F.col("trade_date") < today)
    short = judged & (F.col("n") < PER_DAY_THRESHOLD * F.col("expected"))
    months = days.groupBy("month").agg(F.count_if(short).alias("short_days"))
    have = exported.select(F.col("dt").alias("month")).distinct().withColumn("_have", F.lit(True))
    due = months.join(have, "month", "left").where(F.col("_have").isNull() | (F.col("month") == current))
    decision = (
        F.when(F.col("short_days") == 0, F.lit("write"))
        .when(F.col("month") == current, F.lit("write_with_warning"))
        .otherwise(F.lit("skip"))
    )
    return due.select("month", "short_days", decision.alias("decision"))


def export(bars: DataFrame, decisions: DataFrame, root: str) -> None:
    """Write the bars of the months that passed, all in one job."""
    from barloom.sources.sinks import write_bars

    go = decisions.where(F.col("decision") != "skip").select("month")
    chosen = bars.withColumn("month", F.substring("trade_date", 1, 6)).join(go, "month", "left_semi")
    write_bars(chosen.drop("month"), root)
