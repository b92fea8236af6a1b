"""Profiles of tables and factor series, and repairs derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import delisted_name


def last_date_per_code(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ts_code").agg(F.max("trade_date").alias("last_date"))


def month_counts(df: DataFrame, day: str = "trade_date") -> DataFrame:
    return df.groupBy(F.substring(day, 1, 6).alias("month")).agg(F.count(F.lit(1)).alias("n_rows"))


def factor_coverage(long: DataFrame) -> DataFrame:
    """First and last date and number of months of every factor, in one aggregate.

    Months collapse to one row per (factor, month) first, which bounds the distinct count.
    """
    per_month = long.groupBy("factor_name", F.substring("trade_date", 1, 6).alias("month")).agg(
        F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")
    )
    return per_month.groupBy("factor_name").agg(
        F.min("lo").alias("start_date"), F.max("hi").alias("end_date"), F.count(F.lit(1)).alias("month_count")
    )


def table_profile(tables: dict[str, tuple[DataFrame, str]], start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows, first and last date of each table, optionally within a window."""
    parts = []
    for name, (df, day) in tables.items():
        d = F.col(day)
        if start:
            df = df.where(d >= start)
        if end:
            df = df.where(d <= end)
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(d).alias("min_date"), F.max(d).alias("max_date")).withColumn(
                "table_name", F.lit(name)
            )
        )
    return reduce(DataFrame.unionByName, parts)


def delist_backfill(listing: DataFrame, bars: DataFrame, dry_run: bool = False) -> DataFrame:
    """For names with the delisting mark: the date before, the last bar date as the date after, and what happens."""
    marked = listing.where(delisted_name(F.col("name"), F.col("fullname"))).select(
        "ts_code", "name", F.col("delist_date").alias("delist_before")
    )
    out = marked.join(last_date_per_code(bars), "ts_code", "left")
    outcome = (
        F.when(F.col("last_date").isNull(), F.lit("no_bars"))
        .when(F.col("delist_before").eqNullSafe(F.col("last_date")), F.lit("unchanged"))
        .otherwise(F.lit("to_update" if dry_run else "updated"))
    )
    return out.select("ts_code", "name", "delist_before", F.col("last_date").alias("delist_after"), outcome.alias("outcome"))


def last_quote(bars: DataFrame) -> DataFrame:
    """Last bar of each code, its previous close and the relative change.

    One reading: a code's two newest bars by row number, which Spark limits before the shuffle; the others never move.
    """
    newest = Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))
    two = bars.select("ts_code", "trade_date", "close").withColumn("_i", F.row_number().over(newest)).where("_i <= 2")
    pick = lambda c, i: F.max(F.when(F.col("_i") == i, F.col(c)))
    quote = two.groupBy("ts_code").agg(
        pick("trade_date", 1).alias("trade_date"), pick("close", 1).alias("close"), pick("close", 2).alias("pre_close")
    )
    change = F.when(F.col("pre_close") != 0, F.col("close") / F.col("pre_close") - 1.0)
    return quote.withColumn("change_pct", change)
