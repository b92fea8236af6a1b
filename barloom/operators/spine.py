"""Date spines and calendar arithmetic on 8-character date strings.

Spines are bounded by the calendar (about 13,000 days since 1990), so a window over a whole spine is one small task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# Fixed value: quarterly reports start with this year; before it only half-years are due.
QUARTERLY_SINCE = "2005"


def to_day(s: Column) -> Column:
    return F.to_date(s, "yyyyMMdd")


def ymd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


def _bounds(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.lit(start).alias("s"), F.lit(end).alias("e"))


def calendar_days_of(bounds: DataFrame) -> DataFrame:
    """(date_key) of every day of the closed range. `bounds`, here and below: one row (s, e), as a query over stored dates
    yields it; none where s > e or a bound is null."""
    days = bounds.where("s <= e").select(F.explode(F.sequence(to_day(F.col("s")), to_day(F.col("e")))).alias("d"))
    return days.select(ymd(F.col("d")).alias("date_key"))


def months_of(bounds: DataFrame) -> DataFrame:
    """YYYYMM of the closed range."""
    first = lambda c: to_day(F.concat(F.substring(c, 1, 6), F.lit("01")))
    months_ = F.explode(F.sequence(first("s"), first("e"), F.expr("interval 1 month")))
    return bounds.where("substring(s, 1, 6) <= substring(e, 1, 6)").select(months_.alias("d")).select(F.date_format("d", "yyyyMM").alias("month"))


def report_periods_of(bounds: DataFrame) -> DataFrame:
    """Quarter ends of the closed range; only 0630 and 1231 before quarterly reporting."""
    at = lambda c, day: to_day(F.concat(F.substring(c, 1, 4), F.lit(day)))
    # The optimizer may evaluate the sequence before the filter, and one that runs backwards is an error.
    quarters = F.explode(F.when(F.col("s") <= F.col("e"), F.sequence(at("s", "0301"), at("e", "1201"), F.expr("interval 3 month"))))
    p = bounds.where("s <= e").select("s", "e", quarters.alias("d")).select("s", "e", ymd(F.last_day("d")).alias("end_date"))
    due = (F.substring("end_date", 1, 4) >= QUARTERLY_SINCE) | F.substring("end_date", 5, 4).isin("0630", "1231")
    return p.where((F.col("end_date") >= F.col("s")) & (F.col("end_date") <= F.col("e")) & due).select("end_date")


def calendar_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return calendar_days_of(_bounds(spark, start, end))


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    return months_of(_bounds(spark, start, end))


def report_periods(spark: SparkSession, start: str, end: str) -> DataFrame:
    return report_periods_of(_bounds(spark, start, end))


def annual_only(periods: DataFrame) -> DataFrame:
    return periods.where(F.col("end_date").endswith("1231"))


def open_dates(calendar: DataFrame, start: str | None = None, end: str | None = None, exchange: str = "SSE") -> DataFrame:
    """Open days of one exchange."""
    c = calendar.where((F.col("exchange") == exchange) & (F.col("is_open") == "1"))
    if start:
        c = c.where(F.col("cal_date") >= start)
    if end:
        c = c.where(F.col("cal_date") <= end)
    return c.select(F.col("cal_date").alias("trade_date"))


def period_of(day: Column, freq: str) -> Column:
    """The month or ISO week of a day."""
    if freq == "weekly":
        d = to_day(day)
        # The ISO year is the year of the week's Thursday.
        thursday = F.date_add(F.trunc(d, "week"), 3)
        return F.concat(F.date_format(thursday, "yyyy"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    if freq == "monthly":
        return F.substring(day, 1, 6)
    raise ValueError(f"unknown frequency: {freq}")


def last_of_period(opens: DataFrame, freq: str = "monthly") -> DataFrame:
    """Last open day of every month or ISO week: (period, trade_date)."""
    period = period_of(F.col("trade_date"), freq)
    return opens.groupBy(period.alias("period")).agg(F.max("trade_date").alias("trade_date"))


def rebalance_dates(calendar: DataFrame, start: str, end: str, freq: str = "monthly") -> DataFrame:
    """Rebalance days of the range."""
    return last_of_period(open_dates(calendar, start, end), freq).select("trade_date")


def nearest_open(keys: DataFrame, key: str, opens: DataFrame, out: str = "open_date") -> DataFrame:
    """As-of: the latest open day on or before each key, null if there is none.

    Only distinct days enter the window; the rows themselves meet the result in an equi-join.
    """
    days = keys.select(F.col(key).alias("_d")).distinct().withColumn("_open", F.lit(None).cast("string"))
    marks = opens.select(F.col("trade_date").alias("_d"), F.col("trade_date").alias("_open")).distinct()
    run = Window.orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    filled = days.unionByName(marks).groupBy("_d").agg(F.max("_open").alias("_open"))
    filled = filled.withColumn(out, F.last("_open", ignorenulls=True).over(run)).drop("_open")
    days = filled.withColumnRenamed("_d", key)
    return keys.join(days, key, "left")


def newest_first_page(spine: DataFrame, key: str, page: int, size: int) -> DataFrame:
    """Lowest and highest key of page `page` (from 1) of a spine read newest first; no row when out of range."""
    placed = spine.select(key, F.row_number().over(Window.orderBy(F.col(key).desc())).alias("_i"))
    hit = placed.where(F.col("_i").between((page - 1) * size + 1, page * size))
    return hit.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 0")


def page_of(spine: DataFrame, key: str, page: int, size: int) -> DataFrame:
    """The spine's rows on one newest-first page."""
    b = newest_first_page(spine, key, page, size)
    return spine.where(F.col(key).between(b.select("lo").scalar(), b.select("hi").scalar())).orderBy(F.desc(key))


def incremental_start(stored: DataFrame, date_col: str, configured: str) -> DataFrame:
    """Later of the configured start and the day after the last stored one."""
    nxt = ymd(F.date_add(to_day(F.max(date_col)), 1))
    return stored.agg(F.greatest(F.lit(configured), nxt).alias("start_date"))


def incremental_start_month(stored: DataFrame, date_col: str, configured: str, by: list[str] | None = None) -> DataFrame:
    """Later of the configured month and the month after the last stored one."""
    nxt = F.date_format(F.add_months(to_day(F.concat(F.substring(F.max(date_col), 1, 6), F.lit("01"))), 1), "yyyyMM")
    return stored.groupBy(*(by or [])).agg(F.greatest(F.lit(configured), nxt).alias("start_month"))


def coverage_gaps(stored: DataFrame, date_col: str, start: str, end: str) -> DataFrame:
    """Parts of [start, end] outside the stored range: nothing, a head, a tail, both, or all of it."""
    b = stored.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    whole = F.struct(F.lit("all").alias("part"), F.lit(start).alias("gap_start"), F.lit(end).alias("gap_end"))
    head = F.struct(
        F.lit("head").alias("part"),
        F.lit(start).alias("gap_start"),
        F.least(F.lit(end), ymd(F.date_sub(to_day(F.col("lo")), 1))).alias("gap_end"),
    )
    tail = F.struct(
        F.lit("tail").alias("part"),
        F.greatest(F.lit(start), ymd(F.date_add(to_day(F.col("hi")), 1))).alias("gap_start"),
        F.lit(end).alias("gap_end"),
    )
    parts = F.when(F.col("lo").isNull(), F.array(whole)).otherwise(
        F.filter(
            F.array(F.when(F.col("lo") > start, head), F.when(F.col("hi") < end, tail)), lambda p: p.isNotNull()
        )
    )
    return b.select(F.explode(parts).alias("p")).select("p.part", "p.gap_start", "p.gap_end")
