"""Who is listed, suspended and investable on a date, for all dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import is_b_share
from barloom.operators.spine import to_day, ymd

# The exchanges of the A-share market, the age of a new listing in calendar days.
A_EXCHANGES = ("SSE", "SZSE", "BSE")
MIN_AGE_DAYS = 60


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def listed_on(day: Column, list_date: Column, delist_date: Column, keep_delist_day: bool = False, blank_listed: bool = False) -> Column:
    """Listed as of `day`: list_date <= day < delist_date, a blank delist_date being open.

    `keep_delist_day` keeps the delisting day itself; `blank_listed` treats a blank list_date as listed.
    """
    alive = _blank(delist_date) | (delist_date >= day if keep_delist_day else delist_date > day)
    born = ~_blank(list_date) & (list_date <= day)
    if blank_listed:
        born = _blank(list_date) | born
    return F.coalesce(born & alive, F.lit(False))


def a_shares(listing: DataFrame) -> DataFrame:
    return listing.where(F.col("exchange").isin(*A_EXCHANGES))


def full_day_suspension(suspend_type: Column, timing: Column) -> Column:
    return (suspend_type == "S") & (F.coalesce(timing, F.lit("")) == "")


def full_day_suspended(suspend: DataFrame) -> DataFrame:
    """(ts_code, trade_date) of all-day suspensions."""
    return suspend.where(full_day_suspension(F.col("suspend_type"), F.col("suspend_timing"))).select("ts_code", "trade_date").distinct()


def keep_listed(rows: DataFrame, listing: DataFrame, day: str) -> DataFrame:
    """Rows whose code is listed on their day: an equi-join on the code with the life span as residual.

    A listing of some thousand codes is broadcast, so the rows stay where they are; a large one is a shuffle join.
    """
    life = listing.select(F.col("ts_code").alias("_c"), "list_date", "delist_date")
    cond = (rows["ts_code"] == F.col("_c")) & listed_on(rows[day], F.col("list_date"), F.col("delist_date"))
    return rows.join(life, cond, "left_semi")


def investable(candidates: DataFrame, listing: DataFrame, suspend: DataFrame, min_age_days: int = MIN_AGE_DAYS) -> DataFrame:
    """Rows of `candidates` (ts_code, trade_date, ...) that may be held on their date: an A share listed on it for
    at least `min_age_days`, no ST in the name, not suspended all day. A blank list_date passes the age test."""
    ok_name = ~F.upper(F.coalesce(F.col("name"), F.lit(""))).contains("ST")
    life = a_shares(listing).where(ok_name).select(F.col("ts_code").alias("_c"), "list_date", "delist_date")
    day = candidates["trade_date"]
    cutoff = ymd(F.date_sub(to_day(day), min_age_days))
    old = _blank(F.col("list_date")) | (F.col("list_date") <= cutoff)
    listed = listed_on(day, F.col("list_date"), F.col("delist_date"))
    kept = candidates.join(life, (candidates["ts_code"] == F.col("_c")) & listed & old, "left_semi")
    return kept.join(full_day_suspended(suspend), ["ts_code", "trade_date"], "left_anti")


def listed_counts(listing: DataFrame, dates: DataFrame, key: str = "date_key", skip_b: bool = True, survivors_only: bool = False) -> DataFrame:
    """Listed codes on each date, by a sweep: +1 at listing, -1 at delisting, summed up to the date.

    Listings collapse to one row per day before the running sum, so it is bounded by days. `survivors_only` leaves
    out every code that was ever delisted.
    """
    live = listing.where(~_blank(F.col("list_date")))
    if skip_b:
        live = live.where(~is_b_share(F.col("ts_code")))
    if survivors_only:
        live = live.where(_blank(F.col("delist_date")))
    gone = ~_blank(F.col("delist_date"))
    steps = live.select(
        F.explode(
            F.when(
                gone & (F.col("delist_date") > F.col("list_date")),
                F.array(
                    F.struct(F.col("list_date").alias("d"), F.lit(1).alias("s")),
                    F.struct(F.col("delist_date").alias("d"), F.lit(-1).alias("s")),
                ),
            ).when(~gone, F.array(F.struct(F.col("list_date").alias("d"), F.lit(1).alias("s"))))
        ).alias("e")
    ).select("e.d", "e.s")
    marks = dates.select(F.col(key).alias("d")).distinct().withColumn("s", F.lit(0)).withColumn("wanted", F.lit(True))
    per_day = (
        steps.withColumn("wanted", F.lit(False))
        .unionByName(marks)
        .groupBy("d")
        .agg(F.sum("s").alias("s"), F.max("wanted").alias("wanted"))
    )
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_day.withColumn("listed_count", F.sum("s").over(run)).where("wanted").select(F.col("d").alias(key), "listed_count")


def active_counts(listing: DataFrame, dates: DataFrame, opens: DataFrame, suspend: DataFrame) -> DataFrame:
    """(date_key, listed_count, trading_count): trading is listed less all-day suspended on open days, else null."""
    life = listing.where(~_blank(F.col("list_date")) & ~is_b_share(F.col("ts_code")))
    halted = (
        keep_listed(full_day_suspended(suspend), life, "trade_date")
        .groupBy(F.col("trade_date").alias("date_key"))
        .agg(F.count(F.lit(1)).alias("_halted"))
    )
    open_marks = opens.select(F.col("trade_date").alias("date_key"), F.lit(True).alias("_open"))
    out = listed_counts(listing, dates).join(open_marks, "date_key", "left").join(halted, "date_key", "left")
    trading = F.when(F.col("_open"), F.col("listed_count") - F.coalesce(F.col("_halted"), F.lit(0)))
    return out.select("date_key", "listed_count", trading.alias("trading_count"))


def denominators(keys: DataFrame, key: str, counts: DataFrame, opens: DataFrame, column: str = "trading_count") -> DataFrame:
    """Stored count of the nearest open day on or before each key, 0 where there is none."""
    from barloom.operators.spine import nearest_open

    asof = nearest_open(keys.select(key).distinct(), key, opens)
    c = counts.select(F.col("date_key").alias("open_date"), F.col(column).alias("_v"))
    return asof.join(c, "open_date", "left").select(key, F.coalesce(F.col("_v"), F.lit(0)).alias("expected"))


def search(listing: DataFrame, text: dict[str, str], exact: dict[str, str], flags: dict[str, str]) -> DataFrame:
    """Case-insensitive contains on text columns, equality on others, Y/N flags stored as 1/0."""
    out = listing
    for c, v in text.items():
        out = out.where(F.lower(F.col(c)).contains(v.lower()))
    for c, v in exact.items():
        out = out.where(F.col(c) == v)
    for c, v in flags.items():
        out = out.where(F.col(c) == F.lit(1 if v.upper() == "Y" else 0))
    return out


def names_for(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Name and life span of each row's code, kept where the code is unknown."""
    return rows.join(listing.select("ts_code", "name", "list_date", "delist_date"), "ts_code", "left")
