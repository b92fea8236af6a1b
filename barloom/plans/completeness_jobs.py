"""Completeness as whole jobs: snapshot, scan, gap list, per-security checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import completeness, daybits, gaps, merge, registry, spine, universe
from barloom.plans import upkeep


def bar_completeness(bars: DataFrame, listing: DataFrame, calendar: DataFrame, suspend: DataFrame) -> DataFrame:
    """Per open day: expected (trading) count and the three bar counts."""
    opens = spine.open_dates(calendar)
    keys = opens.select(F.col("trade_date").alias("date_key"))
    expected = universe.active_counts(listing, keys, opens, suspend).select(
        F.col("date_key").alias("trade_date"), F.col("trading_count").alias("period_stock_count")
    )
    counts = completeness.bar_counts(bars)
    names = [c for c in counts.columns if c != "trade_date"]
    return expected.join(counts, "trade_date", "left").select(
        "trade_date", "period_stock_count", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names]
    )


def report_completeness(counts: DataFrame, companies: DataFrame, periods: DataFrame) -> DataFrame:
    """Per due period: listed count and the row count of every report table. `counts`: `completeness.period_counts`."""
    names = [c for c in counts.columns if c != "end_date"]
    listed = universe.listed_counts(companies, periods, "end_date")
    return listed.join(counts, "end_date", "left").select(
        "end_date", "listed_count", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in names]
    )


def refresh(stored: DataFrame, source: str, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Stored snapshots with one source's keys counted anew."""
    return merge.upsert(stored, completeness.snapshot(source, expected, actual), ["source_name", "date_key"])


def gap_keys(stored: DataFrame, source: str, expected: DataFrame, actual: DataFrame, start: str, end: str, threshold: float = completeness.THRESHOLD) -> DataFrame:
    """Refresh a range, then its keys below the threshold, ascending."""
    within = F.col("date_key").between(start, end)
    now = refresh(stored, source, expected.where(within), actual)
    below = completeness.below_ratio(now.where((F.col("source_name") == source) & within), threshold)
    return below.select("date_key").orderBy("date_key")


def completeness_cycle(stored: DataFrame, source: str, expected: DataFrame, table: DataFrame, landed: DataFrame, keys: list[str], day: str, threshold: float = completeness.THRESHOLD) -> DataFrame:
    """Snapshot, find the gaps, load the landed rows of the gap keys, snapshot again.

    Loading is an insert of the keys that the table lacks. Returns the snapshots afterwards: the table is counted once, and
    the rows that were loaded are added to its counts.
    """
    before = refresh(stored, source, expected, completeness.count_by_key(table, day))
    short = completeness.below_ratio(before.where(F.col("source_name") == source), threshold).select(F.col("date_key").alias(day))
    loaded = merge.join_keys(landed.join(short, day, "left_semi"), table, keys, "left_anti")
    changes = completeness.count_by_key(loaded, day).select(F.lit(source).alias("source_name"), "date_key", F.col("resolved_count").alias("change"))
    return upkeep.kept_up(before, changes, expected.select(F.lit(source).alias("source_name"), "date_key", "expected"))


def bar_check(listing: DataFrame, calendar: DataFrame, suspended: DataFrame, bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Missing ranges of every code in one plan: the expected days less the stored bars, as bitmaps, neighbours merged."""
    return gaps.missing_ranges(listing, spine.open_dates(calendar, start, end), bars, start, end, suspended)


def bar_check_registry(log: DataFrame, listing: DataFrame, calendar: DataFrame, suspended: DataFrame, bars: DataFrame, start: str | None, end: str | None, at) -> DataFrame:
    """The registry after a bar check: missed keys counted, resolved ones gone."""
    opens = spine.open_dates(calendar, start, end)
    missing = gaps.missing_days(listing, opens, bars, start, end, suspended)
    entity = F.lit("kline_daily").alias("missing_entity")
    as_keys = lambda d: d.select("ts_code", entity, F.col("trade_date").alias("missing_date"))
    return registry.forget_resolved(registry.record_missing(log, as_keys(missing), at), as_keys(bars))


def _life(companies: DataFrame, start: str) -> DataFrame:
    """Companies whose reports are due from max(start, list_date) on."""
    born = F.greatest(F.lit(start), F.coalesce(F.col("list_date"), F.lit("")))
    return companies.select("ts_code", born.alias("list_date"), F.lit(None).cast("string").alias("delist_date"))


def report_check(companies: DataFrame, periods: DataFrame, reports: DataFrame, start: str) -> DataFrame:
    """Missing report periods of every company, due from max(start, list_date) on: (ts_code, end_date)."""
    return gaps.missing_days(_life(companies, start), periods, reports, day="end_date")


def report_check_spans(companies: DataFrame, periods: DataFrame, reports: DataFrame, start: str) -> DataFrame:
    """First, last and number of the missing periods of every company that misses any."""
    return gaps.missing_spans(_life(companies, start), periods, reports, day="end_date")


def report_check_summary(companies: DataFrame, periods: DataFrame, reports: DataFrame, start: str) -> DataFrame:
    """Companies that were never delisted: how many have every period, how many do not, how many periods miss."""
    alive = companies.where(F.coalesce(F.col("delist_date"), F.lit("")) == "")
    missing = report_check_spans(alive, periods, reports, start).select(F.lit(0).alias("all"), F.lit(1).alias("failed"), F.col("n_missing").alias("missing"))
    every = alive.select(F.lit(1).alias("all"), F.lit(0).alias("failed"), F.lit(0).cast("long").alias("missing"))
    sums = every.unionByName(missing).agg(F.sum("all").alias("all"), F.sum("failed").alias("failed"), F.sum("missing").alias("missing"))
    return sums.select((F.coalesce("all", F.lit(0)) - F.coalesce("failed", F.lit(0))).alias("passed"), F.coalesce("failed", F.lit(0)).alias("failed"), "missing")


def missing_periods_since_first(companies: DataFrame, periods: DataFrame, reports: DataFrame, start: str, end: str) -> DataFrame:
    """Missing periods per company in [start, end], from its first observed period if that is later (due or not).

    Reports are read once: what a company has, as bitmaps, and its first period come from the same aggregate."""
    within = F.col("end_date").between(start, end)
    days = daybits.Calendar.of(periods.where(within), "end_date")
    n, no_word = F.col("n"), F.lit(None).cast("int").alias("word")
    placed = reports.where(within).select("ts_code", "end_date").join(days.numbered("end_date"), "end_date", "left")
    seen = placed.select("ts_code", F.floor(n / 64).cast("int").alias("word"), F.when(n.isNotNull(), daybits.bit(n)).alias("bits"), "end_date")
    seen = seen.groupBy("ts_code", "word").agg(F.bit_or("bits").alias("bits"), F.min("end_date").alias("first"), F.lit(False).alias("known"))
    every = companies.select("ts_code", no_word, F.lit(None).cast("long").alias("bits"), F.lit(None).cast("string").alias("first"), F.lit(True).alias("known"))
    each = seen.unionByName(every).groupBy("ts_code").agg(
        F.min("first").alias("first"), F.max("known").alias("known"), F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "bits"))).alias("seen")
    )
    begin = F.when(F.col("first").isNull(), F.lit(0)).otherwise(daybits.before(F.col("_days"), F.col("first")))
    each = each.where("known").select("ts_code", "first", "seen", days.days.alias("_days"))
    life = each.select("ts_code", begin.alias("a"), F.size("_days").alias("b"), "seen")
    w = F.explode(daybits.span_words(F.col("a"), F.col("b"))).alias("d")
    due = life.where("a < b").select("ts_code", "seen", w).select("ts_code", "d.word", "d.bits", "seen")
    mine = F.coalesce(F.get(F.filter("seen", lambda s: s["word"] == F.col("word")), F.lit(0))["bits"], F.lit(0).cast("long"))
    missing = due.select("ts_code", "word", F.col("bits").bitwiseAND(F.bitwise_not(mine)).alias("bits")).where("bits <> 0")
    return daybits.unpacked(missing, days, "ts_code", "end_date")
