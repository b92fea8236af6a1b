"""How complete a landed table is per date key, against an expected count.

Snapshots are (source_name, date_key, period_stock_count, resolved_count). The three threshold tests of the
domain differ and are kept apart: `below_ratio`, `below_share`, `macro_scan`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.universe import listed_counts
from barloom.session import stage

# Fixed value: default completeness threshold.
THRESHOLD = 0.95
# Fixed value: buckets of a sketch, as a power of two; a standard error of 0.8 %.
SKETCH_LG = 14


def count_by_key(df: DataFrame, date_col: str, key: str = "date_key", distinct: list[str] | None = None) -> DataFrame:
    """Rows per date key, dashes stripped, blank keys dropped."""
    k = F.regexp_replace(F.col(date_col), "-", "")
    rows = df.select(k.alias(key), *(distinct or [])).where(F.coalesce(F.col(key), F.lit("")) != "")
    return (rows.distinct() if distinct else rows).groupBy(key).agg(F.count(F.lit(1)).alias("resolved_count"))


def bar_counts(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars, bars with a factor, bars with both limits per date: one pass."""
    b = bars.where(F.coalesce(F.col("trade_date"), F.lit("")) != "")
    if start:
        b = b.where(F.col("trade_date") >= start)
    if end:
        b = b.where(F.col("trade_date") <= end)
    return b.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("kline_daily_count"),
        F.count("adj_factor").alias("kline_adj_factor_count"),
        F.count_if(F.col("up_limit").isNotNull() & F.col("down_limit").isNotNull()).alias("kline_stk_limit_count"),
    )


def snapshot(source: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Snapshot of a source: `expected` (date_key, expected) is the spine; keys without rows resolve 0."""
    return expected.join(actual, "date_key", "left").select(
        F.lit(source).alias("source_name"),
        "date_key",
        F.col("expected").cast("bigint").alias("period_stock_count"),
        F.coalesce(F.col("resolved_count"), F.lit(0)).cast("bigint").alias("resolved_count"),
    )


def sticky_snapshot(source: str, keys: DataFrame, actual: DataFrame, previous: DataFrame) -> DataFrame:
    """Snapshot of an event-driven source: 1 expected per key; the row count if there are rows, else 1 if the key was
    ever resolved or marked as pulled, else 0."""
    before = previous.where(F.col("source_name") == source).select("date_key", F.col("resolved_count").alias("_before"))
    joined = keys.select("date_key").join(actual, "date_key", "left").join(before, "date_key", "left")
    now = F.coalesce(F.col("resolved_count"), F.lit(0))
    resolved = F.when(now >= 1, now).when(F.coalesce(F.col("_before"), F.lit(0)) >= 1, F.lit(1)).otherwise(F.lit(0))
    return joined.select(
        F.lit(source).alias("source_name"),
        "date_key",
        F.lit(1).cast("bigint").alias("period_stock_count"),
        resolved.cast("bigint").alias("resolved_count"),
    )


def mark_pulled(snapshots: DataFrame, source: str, keys: DataFrame) -> DataFrame:
    """Snapshots after an empty pull of the given keys: (1, 1) each."""
    from barloom.operators.merge import upsert

    one = F.lit(1).cast("bigint")
    marks = keys.select(
        F.lit(source).alias("source_name"), "date_key", one.alias("period_stock_count"), one.alias("resolved_count")
    )
    return upsert(snapshots, marks, ["source_name", "date_key"])


def below_ratio(snapshots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Snapshot keys with resolved / expected under the threshold; nothing expected is no gap."""
    n = F.col("period_stock_count")
    return snapshots.where((n > 0) & (F.try_divide(F.col("resolved_count"), n) < threshold))


def below_share(counts: DataFrame, count: str, expected: str, threshold: float = THRESHOLD) -> DataFrame:
    """Keys with count under threshold * expected."""
    return counts.where((F.col(expected) > 0) & (F.col(count) < threshold * F.col(expected)))


def macro_scan(counts: DataFrame, count: str, expected: str, key: str = "date_key") -> DataFrame:
    """Days that reach floor(0.95 * expected), days that do not, rows missing to that floor, expected of the last key."""
    n = F.col(expected)
    floor = F.floor(THRESHOLD * n)
    due, short = n > 0, F.col(count) < floor
    return counts.agg(
        F.count_if(due & ~short).alias("pass_days"),
        F.count_if(due & short).alias("fail_days"),
        F.coalesce(F.sum(F.when(due & short, floor - F.col(count))), F.lit(0)).cast("bigint").alias("missing_records"),
        F.max_by(n, F.col(key)).cast("bigint").alias("active_stock"),
    )


def period_counts(rows: DataFrame, tables: dict[str, Column], key: str = "end_date") -> DataFrame:
    """Rows per period of several tables in one pass: `tables` names for each what a row adds to its count (a condition's
    0 or 1, or a stored count). Periods that no table has are left out."""
    sums = rows.groupBy(key).agg(*[F.sum(n).cast("bigint").alias(f"{t}_count") for t, n in tables.items()])
    return sums.where(F.greatest(F.lit(0), *[F.col(f"{t}_count") for t in tables]) > 0)


def with_listed_count(per: DataFrame, companies: DataFrame, key: str = "end_date") -> DataFrame:
    """`per`, one row per period, with the listed count. Staged, as its periods are swept as well."""
    per = stage(per)
    return per.join(listed_counts(companies, per, key), key, "left").withColumn(
        "listed_count", F.coalesce(F.col("listed_count"), F.lit(0)).cast("bigint")
    )


def merge_period_counts(tables: dict[str, DataFrame], companies: DataFrame, key: str = "end_date") -> DataFrame:
    """Row counts of several report tables per period (0 where a table has none), with the listed count."""
    tagged = reduce(DataFrame.unionByName, [t.select(key, F.lit(n).alias("_t")) for n, t in tables.items()])
    each = {n: F.when(F.col("_t") == n, 1).otherwise(0) for n in tables}
    return with_listed_count(period_counts(tagged, each, key), companies, key)


def peak_universe(df: DataFrame, day: str, end: str) -> DataFrame:
    """Largest number of distinct codes on one day up to `end`; (day, code) pairs collapse map-side."""
    pairs = df.where(F.col(day) <= end).select(day, "ts_code").distinct()
    return pairs.groupBy(day).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("peak"))


def daily_sketches(df: DataFrame, day: str, code: str = "ts_code", lg: int = SKETCH_LG) -> DataFrame:
    """(day, sketch): the day's codes as a mergeable HyperLogLog sketch of 2 ** lg buckets, to be stored beside the day."""
    return df.groupBy(day).agg(F.hll_sketch_agg(code, lg).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Column, out: str) -> DataFrame:
    """(out, sketch): stored sketches united by a coarser key, such as the month or the year of their day."""
    return sketches.groupBy(by.alias(out)).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """The estimated number of distinct codes in place of the sketch. The standard error is 1.04 / sqrt(2 ** lg)."""
    return sketches.withColumn("n_codes", F.hll_sketch_estimate("sketch")).drop("sketch")


def peak_universe_estimate(sketches: DataFrame, day: str, end: str) -> DataFrame:
    """`peak_universe` from stored sketches: days only, no codes."""
    return sketched_counts(sketches.where(F.col(day) <= end)).agg(F.max("n_codes").alias("peak"))


def metric(count: Column, expected: Column, threshold: Column, has_snapshot: Column) -> dict[str, Column]:
    """Dashboard cell: ratio and is_complete. A threshold of 0 is always complete; no snapshot is incomplete."""
    free = threshold <= 0
    ratio = F.when(free, F.when(expected > 0, F.lit(1.0))).when(expected > 0, count / expected)
    complete = F.when(free, F.lit(True)).otherwise(F.coalesce(F.try_divide(count, expected) >= threshold, F.lit(False)))
    return {
        "ratio": F.when(has_snapshot, ratio),
        "is_complete": has_snapshot & complete,
    }


def row_complete(is_complete: str = "is_complete", has_snapshot: str = "has_snapshot") -> Column:
    """Aggregate: every cell with a snapshot is complete, and there is one."""
    every = F.bool_and(F.when(F.col(has_snapshot), F.col(is_complete)))
    return F.coalesce(every, F.lit(False))


def group_summary(cells: DataFrame) -> DataFrame:
    """Health of each group over its cells; cells with threshold 0 count only for the rows.

    cells: group_id, date_key, column_key, ratio, threshold, is_complete, has_snapshot.
    """
    due = F.col("threshold") > 0
    ok = F.col("is_complete")
    gap = due & ~ok
    worst = F.min_by("column_key", F.when(due & F.col("ratio").isNotNull(), F.struct("ratio", F.col("column_key"))))
    per_row = cells.groupBy("group_id", "date_key").agg(
        row_complete().alias("row_ok"),
        F.count_if(due).alias("cells"),
        F.count_if(due & ok).alias("complete"),
        F.count_if(gap).alias("gaps"),
        worst.alias("worst_column"),
        F.min(F.when(due, F.col("ratio"))).alias("worst_ratio"),
    )
    s = per_row.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("window_row_count"),
        F.count_if("row_ok").alias("rows_complete"),
        F.sum("cells").alias("cells"),
        F.sum("complete").alias("complete"),
        F.sum("gaps").cast("bigint").alias("gap_cell_count"),
        F.min("worst_ratio").alias("worst_ratio"),
        F.min_by("worst_column", F.when(F.col("worst_ratio").isNotNull(), F.struct("worst_ratio", "worst_column"))).alias("worst_column"),
        F.max(F.when(F.col("gaps") > 0, F.col("date_key"))).alias("latest_gap_date_key"),
    )
    rate = F.when(F.col("cells") > 0, F.col("complete") / F.col("cells")).otherwise(F.lit(1.0))
    # Fixed value: share of complete cells that is still a warning.
    status = (
        F.when((F.col("cells") > 0) & (F.col("complete") == F.col("cells")), F.lit("healthy"))
        .when(rate >= 0.8, F.lit("warning"))
        .otherwise(F.lit("critical"))
    )
    return s.select(
        "group_id",
        "window_row_count",
        "rows_complete",
        F.round(rate, 4).alias("complete_rate"),
        "gap_cell_count",
        status.alias("status"),
        "worst_column",
        "worst_ratio",
        "latest_gap_date_key",
    )


def freshness(latest: Column, reference: Column) -> dict[str, Column]:
    """Lag in days behind the reference day, and ok (<=1), warning (<=3) or critical."""
    lag = F.datediff(F.to_date(reference, "yyyyMMdd"), F.to_date(latest, "yyyyMMdd"))
    status = (
        F.when(lag.isNull(), F.lit("unknown"))
        .when(lag <= 1, F.lit("ok"))
        .when(lag <= 3, F.lit("warning"))
        .otherwise(F.lit("critical"))
    )
    return {"lag_days": lag, "status": status}
