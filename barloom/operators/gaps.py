"""Expected keys, missing keys, and the ranges they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators import daybits


def missing_words(
    listing: DataFrame,
    opens: DataFrame,
    have: DataFrame | None,
    start: str | None = None,
    end: str | None = None,
    suspended: DataFrame | None = None,
    day: str = "trade_date",
    keep_delist_day: bool = False,
    need_list_date: bool = False,
) -> tuple[DataFrame, daybits.Calendar]:
    """Bitmaps (ts_code, word, bits) of the open days of each code within its life span that it neither has (`have`: ts_code
    and the day) nor was suspended on, and the calendar that numbers them.

    `keep_delist_day` counts the delisting day as a listed one; `need_list_date` leaves out codes without a list_date.

    A life span is two numbers of the calendar and becomes some words of mask; what a code has is a bit a row that map-side
    combining collapses. The grid of all codes and days is never made.
    """
    lo = F.coalesce(F.col("list_date"), F.lit(""))
    hi = F.coalesce(F.col("delist_date"), F.lit(""))
    if start:
        opens = opens.where(F.col(day) >= start)
    if end:
        opens = opens.where(F.col(day) <= end)
    if need_list_date:
        listing = listing.where(lo != "")
    days = daybits.Calendar.of(opens, day)
    listing = listing.select("ts_code", lo.alias("_lo"), hi.alias("_hi"), days.days.alias("_days"))
    all_days, lo, hi = F.col("_days"), F.col("_lo"), F.col("_hi")
    # The day after is the first one later than `hi`: nothing lies between a text and itself with a NUL behind it.
    upto = daybits.before(all_days, F.concat(hi, F.lit("\0")) if keep_delist_day else hi)
    spans = listing.select("ts_code", daybits.before(all_days, lo).alias("a"), F.when(hi == "", F.size(all_days)).otherwise(upto).alias("b"))
    known = [daybits.held(x, days, "ts_code", day) for x in (have, suspended) if x is not None]
    return daybits.without(daybits.spanned(spans, "ts_code"), known, "ts_code"), days


def missing_days(listing: DataFrame, opens: DataFrame, have: DataFrame | None, start: str | None = None, end: str | None = None, suspended: DataFrame | None = None, day: str = "trade_date", **options) -> DataFrame:
    """`missing_words` as rows (ts_code, day)."""
    words, days = missing_words(listing, opens, have, start, end, suspended, day, **options)
    return daybits.unpacked(words, days, "ts_code", day)


def missing_ranges(*args, **options) -> DataFrame:
    """`missing_words` as (ts_code, gap_start, gap_end, n_days): missing days that are neighbours in the open calendar are
    one range."""
    return daybits.runs_of(*missing_words(*args, **options), "ts_code")


def missing_spans(*args, **options) -> DataFrame:
    """`missing_words` as (ts_code, first_missing, last_missing, n_missing)."""
    return daybits.spans_of(*missing_words(*args, **options), "ts_code")


def expected_grid(listing: DataFrame, opens: DataFrame, start: str | None = None, end: str | None = None, suspended: DataFrame | None = None, **options) -> DataFrame:
    """Open days of each code within its life span, less its all-day suspensions; options as for `missing_words`."""
    return missing_days(listing, opens, None, start, end, suspended, **options)


def missing_keys(expected: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are not resolved."""
    return expected.select(*keys).join(resolved.select(*keys), keys, "left_anti")


def merge_consecutive(missing: DataFrame, opens: DataFrame, by: str = "ts_code", day: str = "trade_date") -> DataFrame:
    """Missing days that are neighbours in the open calendar, merged into ranges.

    Per code a window over its missing days: bounded by the calendar.
    """
    numbered = opens.select(day).distinct().withColumn("_n", F.row_number().over(Window.orderBy(day)))
    island = F.col("_n") - F.row_number().over(Window.partitionBy(by).orderBy("_n"))
    return (
        missing.select(by, day)
        .join(numbered, day)
        .withColumn("_island", island)
        .groupBy(by, "_island")
        .agg(F.min(day).alias("gap_start"), F.max(day).alias("gap_end"), F.count(F.lit(1)).alias("n_days"))
        .drop("_island")
    )


def missing_span(missing: DataFrame, by: list[str], day: str) -> DataFrame:
    """First and last missing key per group: the range to pull."""
    return missing.groupBy(*by).agg(F.min(day).alias("first_missing"), F.max(day).alias("last_missing"), F.count(F.lit(1)).alias("n_missing"))


def effective_end(per_day: DataFrame, end: str, threshold: float = 0.95) -> DataFrame:
    """Latest day on or before `end` whose count reaches the threshold.

    With none: the day before, if the last day is `end` itself, else the last day, else `end`.
    per_day: trade_date, n, expected.
    """
    days = per_day.where(F.col("trade_date") <= end)
    last = days.agg(F.max("trade_date")).scalar()
    good = F.max(F.when((F.col("expected") > 0) & (F.col("n") >= threshold * F.col("expected")), F.col("trade_date")))
    before = F.max(F.when(F.col("trade_date") < last, F.col("trade_date")))
    picked = days.agg(good.alias("good"), before.alias("before"), F.max("trade_date").alias("last"))
    fallback = F.when(F.col("last") == end, F.coalesce("before", "last")).otherwise(F.col("last"))
    return picked.select(F.coalesce(F.col("good"), fallback, F.lit(end)).alias("effective_end"))
