"""What index series lack: by month or by open day, for a few codes or for a table of them, and the ranges to pull."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import spine
from barloom.operators.gaps import missing_keys, missing_spans

# The indices of a source that names none.
DEFAULT_CODES = ("000300.SH", "000905.SH", "000852.SH", "399006.SZ")


@dataclass(frozen=True)
class IndexSource:
    """A table that is pulled index by index. `unit` says what it should have of each index: every open `day`, or a row in
    every `month`. `start` is its first day, where a check names none."""

    name: str
    unit: str = "month"
    code: str = "index_code"
    day: str = "trade_date"
    start: str = "20050101"

    def __post_init__(self):
        if self.unit not in ("day", "month"):
            raise ValueError(f"unknown unit: {self.unit}")


def _expand(spine: DataFrame, codes: list[str], key: str) -> DataFrame:
    """Every code at every key, by exploding the code list."""
    return spine.select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("ts_code"), key)


def missing_months(codes: list[str], stored: DataFrame, months: DataFrame) -> DataFrame:
    """Months a code has no row in, with the range to pull (the true last day of the month)."""
    have = stored.select("ts_code", F.substring("trade_date", 1, 6).alias("month")).distinct()
    gone = missing_keys(_expand(months, codes, "month"), have, ["ts_code", "month"])
    first = F.concat("month", F.lit("01"))
    return gone.select(
        "ts_code",
        "month",
        first.alias("pull_start"),
        F.date_format(F.last_day(F.to_date(first, "yyyyMMdd")), "yyyyMMdd").alias("pull_end"),
    )


def missing_days(codes: list[str], stored: DataFrame, opens: DataFrame) -> DataFrame:
    """First and last open day each code lacks, and how many it lacks."""
    life = opens.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("ts_code"))
    return missing_spans(life.withColumns({"list_date": F.lit(""), "delist_date": F.lit("")}), opens, stored)


def codes_of(spark: SparkSession, codes: tuple[str, ...] = DEFAULT_CODES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array_distinct(F.array(*[F.lit(c) for c in codes]))).alias("index_code"))


def stored_keys(source: IndexSource, table: DataFrame) -> DataFrame:
    """(index_code, date_key) that the table has: days or months, with or without dashes."""
    key = F.substring(F.regexp_replace(source.day, "-", ""), 1, 8 if source.unit == "day" else 6)
    return table.select(F.trim(source.code).alias("index_code"), key.alias("date_key")).distinct()


def _month_keys(codes: DataFrame, start: str, end: str) -> DataFrame:
    first = lambda day: F.to_date(F.lit(f"{day[:6]}01"), "yyyyMMdd")
    months = F.sequence(first(start), first(end), F.expr("interval 1 month"))
    return codes.select("index_code", F.explode(months).alias("_first")).withColumn("date_key", F.date_format("_first", "yyyyMM"))


def _bounded(source: IndexSource, codes: DataFrame, start: str | None, end: str) -> tuple[DataFrame, str]:
    """The codes, once each, and the first day; no codes where the range is empty."""
    start = start or source.start
    named = codes.select(F.trim("index_code").alias("index_code")).where(F.coalesce(F.col("index_code"), F.lit("")) != "").distinct()
    return (named if start <= end else named.where("false")), min(start, end)


def pull_ranges(source: IndexSource, table: DataFrame, codes: DataFrame, calendar: DataFrame, end: str, start: str | None = None) -> DataFrame:
    """(source_name, index_code, pull_start, pull_end, n_missing): what to pull so that nothing is missing in [start, end].

    By day one range an index, from its first to its last missing open day; by month one for each missing month, to the true
    end of the month. An index that lacks nothing has no row. `codes` (index_code) may be as long as a table of indices: days
    are held as bitmaps, so an index is some hundred words and not a row a day.
    """
    named, start = _bounded(source, codes, start, end)
    have = stored_keys(source, table)
    if source.unit == "day":
        life = named.select(F.col("index_code").alias("ts_code"), F.lit("").alias("list_date"), F.lit("").alias("delist_date"))
        held = have.select(F.col("index_code").alias("ts_code"), F.col("date_key").alias("trade_date"))
        spans = missing_spans(life, spine.open_dates(calendar, start, end), held)
        out = spans.select(F.col("ts_code").alias("index_code"), F.col("first_missing").alias("pull_start"), F.col("last_missing").alias("pull_end"), "n_missing")
    else:
        gone = _month_keys(named, start, end).join(have, ["index_code", "date_key"], "left_anti")
        day = lambda d: F.date_format(d, "yyyyMMdd")
        out = gone.select("index_code", day("_first").alias("pull_start"), day(F.last_day("_first")).alias("pull_end"), F.lit(1).alias("n_missing"))
    return out.select(F.lit(source.name).alias("source_name"), "index_code", "pull_start", "pull_end", F.col("n_missing").cast("long").alias("n_missing"))


def index_coverage(source: IndexSource, table: DataFrame, codes: DataFrame, calendar: DataFrame, end: str, start: str | None = None) -> DataFrame:
    """(source_name, index_code, n_due, n_have, rate, last_key) of every index: how many keys it should have in [start, end],
    how many of them it has, and the last key it has at all. With nothing due the rate is null."""
    named, first = _bounded(source, codes, start, end)
    if source.unit == "day":
        due = spine.open_dates(calendar, first, end).agg(F.count_distinct("trade_date")).scalar()
    else:
        due = F.lit((int(end[:4]) - int(first[:4])) * 12 + int(end[4:6]) - int(first[4:6]) + 1)
    gone = pull_ranges(source, table, codes, calendar, end, start).groupBy("index_code").agg(F.sum("n_missing").alias("_gone"))
    last = stored_keys(source, table).groupBy("index_code").agg(F.max("date_key").alias("last_key"))
    rows = named.join(gone, "index_code", "left").join(last, "index_code", "left").withColumn("n_due", F.coalesce(due.cast("long"), F.lit(0)))
    n_have = F.col("n_due") - F.coalesce("_gone", F.lit(0))
    rate = F.when(F.col("n_due") > 0, n_have / F.col("n_due"))
    return rows.select(F.lit(source.name).alias("source_name"), "index_code", "n_due", n_have.alias("n_have"), rate.alias("rate"), "last_key")
