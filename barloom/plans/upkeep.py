"""Snapshots that follow the loads instead of counting whole tables again.

A source's rule says how many rows a key should have; what it has changes by what a load inserts, updates and deletes. The
stored counts plus these changes are the new counts, and only the keys that a load touches are written.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import completeness, merge, spine, universe

KEYS = ["source_name", "date_key"]


@dataclass(frozen=True)
class Source:
    """A table under watch. `rule` names what a key should have: `trading` codes on open days, `listed` codes on report
    periods (`annual`: year ends only), one row for each of `indices`, one for an `event`, or `custom` counts."""

    name: str
    day: str
    rule: str = "trading"
    annual: bool = False
    indices: tuple[str, ...] = ()
    custom: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    counts: Column | None = field(default=None, compare=False)  # rows that count; all by default

    def __post_init__(self):
        if self.rule not in ("trading", "listed", "indices", "event", "custom"):
            raise ValueError(f"unknown rule: {self.rule}")
        if (self.rule == "indices" and not self.indices) or (self.rule == "custom" and self.custom is None):
            raise ValueError(f"the rule {self.rule} needs what it counts")


@dataclass(frozen=True)
class Market:
    """What the rules look at. `counts` are stored counts (date_key, listed_count, trading_count), if there are any."""

    listing: DataFrame
    calendar: DataFrame
    periods: DataFrame
    suspend: DataFrame
    counts: DataFrame | None = None


def due_keys(source: Source, market: Market, start: str, end: str) -> DataFrame:
    """(date_key) that the source should have in [start, end]: report periods, or open days."""
    if source.rule == "listed":
        periods = spine.annual_only(market.periods) if source.annual else market.periods
        return periods.select(F.col("end_date").alias("date_key")).where(F.col("date_key").between(start, end))
    return spine.open_dates(market.calendar, start, end).select(F.col("trade_date").alias("date_key"))


def expected_counts(source: Source, market: Market, start: str, end: str) -> DataFrame:
    """(date_key, expected) by the source's rule. Where stored counts lack a key or have 0, it is computed."""
    keys = due_keys(source, market, start, end)
    if source.rule in ("indices", "event"):
        return keys.select("date_key", F.lit(len(source.indices) if source.rule == "indices" else 1).cast("long").alias("expected"))
    if source.rule == "custom":
        return source.custom(market.listing, keys).select("date_key", F.col("expected").cast("long").alias("expected"))
    if source.rule == "listed":
        computed, column = universe.listed_counts(market.listing, keys), "listed_count"
    else:
        computed, column = universe.active_counts(market.listing, keys, spine.open_dates(market.calendar), market.suspend), "trading_count"
    computed = computed.select("date_key", F.coalesce(F.col(column), F.lit(0)).cast("long").alias("expected"))
    if market.counts is None:
        return computed
    stored = market.counts.select("date_key", F.col(column).cast("long").alias("_stored"))
    kept = F.when(F.col("_stored") > 0, F.col("_stored")).otherwise(F.col("expected"))
    return computed.join(stored, "date_key", "left").select("date_key", kept.alias("expected"))


def recounted(source: Source, table: DataFrame, market: Market, start: str, end: str, previous: DataFrame | None = None) -> DataFrame:
    """The source's snapshots of [start, end], counted over the whole table."""
    rows = table if source.counts is None else table.where(source.counts)
    actual = completeness.count_by_key(rows, source.day)
    if source.rule == "event":
        return completeness.sticky_snapshot(source.name, due_keys(source, market, start, end), actual, previous)
    return completeness.snapshot(source.name, expected_counts(source, market, start, end), actual)


def signed_changes(classified: DataFrame, stored: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """What a load does to a table, as rows with a `_sign`: new rows come (+1), the old ones of updates and of deleted keys
    go (-1). `classified` is the result of `merge.classify`; a deleted key that is loaded as well is an update."""
    columns = [c for c in stored.columns if c in classified.columns]
    came = classified.where("diff_class in ('insert', 'update')").select(*columns, F.lit(1).alias("_sign"))
    updated = classified.where("diff_class = 'update'").select(*keys)
    gone = updated
    if deleted is not None:
        gone = updated.unionByName(merge.join_keys(deleted.select(*keys), classified.select(*keys), keys, "left_anti"))
    went = merge.join_keys(stored, gone, keys, "left_semi").select(*columns, F.lit(-1).alias("_sign"))
    return came.unionByName(went)


def count_changes(changes: DataFrame, sources: list[Source]) -> DataFrame:
    """(source_name, date_key, change) of every source over the same signed rows, in one pass; no change is no row. The
    sources of one table share its date column."""
    day = F.regexp_replace(F.col(sources[0].day), "-", "")
    if any(s.day != sources[0].day for s in sources):
        raise ValueError("sources of one table have one date column")
    counted = lambda s: F.col("_sign") if s.counts is None else F.when(s.counts, F.col("_sign")).otherwise(0)
    sums = [F.sum(counted(s)).alias(f"_c{i}") for i, s in enumerate(sources)]
    per_day = changes.withColumn("date_key", day).where(F.coalesce(F.col("date_key"), F.lit("")) != "").groupBy("date_key").agg(*sums)
    rows = F.array(*[F.struct(F.lit(s.name).alias("source_name"), F.col(f"_c{i}").alias("change")) for i, s in enumerate(sources)])
    return per_day.select("date_key", F.explode(rows).alias("r")).select("r.source_name", "date_key", "r.change").where("change <> 0")


def touched(snapshots: DataFrame, changes: DataFrame, expected: DataFrame) -> DataFrame:
    """The snapshots of the touched keys after a load: stored counts plus the changes. A key that had no snapshot gets one
    if it is due (`expected`: source_name, date_key, expected); a key that is neither stored nor due has none."""
    now = changes.join(snapshots, KEYS, "left").join(expected, KEYS, "left")
    due = F.coalesce("period_stock_count", "expected")
    return now.where(due.isNotNull()).select(
        *KEYS,
        due.cast("long").alias("period_stock_count"),
        (F.coalesce("resolved_count", F.lit(0)) + F.col("change")).cast("long").alias("resolved_count"),
    )


def kept_up(snapshots: DataFrame, changes: DataFrame, expected: DataFrame) -> DataFrame:
    """All snapshots after a load. As large as the snapshots: a row for each source and day."""
    return merge.upsert(snapshots, touched(snapshots, changes, expected), KEYS)


def events_kept_up(snapshots: DataFrame, source: Source, table: DataFrame, changes: DataFrame) -> DataFrame:
    """The same for an event-driven source, whose stored 1 may be a mark without a row: its touched keys are counted again,
    and only these (`table` is read with a filter on the days of the load)."""
    keys = changes.where(F.col("source_name") == source.name).select("date_key").distinct()
    day = F.regexp_replace(F.col(source.day), "-", "")
    mine = table.withColumn("_day", day).join(keys.withColumnRenamed("date_key", "_day"), "_day", "left_semi").drop("_day")
    rows = mine if source.counts is None else mine.where(source.counts)
    return merge.upsert(snapshots, completeness.sticky_snapshot(source.name, keys, completeness.count_by_key(rows, source.day), snapshots), KEYS)


def all_expected(sources: list[Source], market: Market, start: str, end: str) -> DataFrame:
    """(source_name, date_key, expected) of several sources."""
    each = [expected_counts(s, market, start, end).select(F.lit(s.name).alias("source_name"), "date_key", "expected") for s in sources]
    return reduce(DataFrame.unionByName, each)
