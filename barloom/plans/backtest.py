"""Cross-section group backtest, set-based over all rebalance dates.

The loop over dates that the definition suggests becomes joins on the rebalance number; the only dependence between dates, holdings
before and after, is a join of the holdings with themselves one number later.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import simple_return
from barloom.functions.scalars import CostRates, adjusted, limit_hit
from barloom.operators import ordering, portfolio, series, spine, universe, xsection
from barloom.session import stage

# The limits of the quality warnings.
MIN_REBALANCES, MIN_DAYS, MAX_MEDIAN_RETURN, MAX_NULL_SHARE = 3, 60, 0.20, 0.05


class Strategy(Protocol):
    """Scores a cross-section (ts_code, trade_date, one column per factor) and weights the investable part of it."""

    factors: list[str]
    n_groups: int

    def scores(self, cross: DataFrame) -> DataFrame:
        """(ts_code, trade_date, value)"""
        ...

    def weights(self, scored: DataFrame) -> DataFrame:
        """(ts_code, trade_date, group_id, weight)"""
        ...


@dataclass(frozen=True)
class SingleFactor:
    """Equal-weight groups by one factor."""

    factor: str
    n_groups: int = 5

    @property
    def factors(self) -> list[str]:
        return [self.factor]

    def scores(self, cross: DataFrame) -> DataFrame:
        return cross.select("ts_code", "trade_date", F.col(self.factor).alias("value")).where(F.col("value").isNotNull())

    def weights(self, scored: DataFrame) -> DataFrame:
        groups = ordering.quantile_groups(scored, "value", self.n_groups, ["trade_date"])
        return portfolio.with_group_id(groups).select("ts_code", "trade_date", "group_id", "weight")


@dataclass(frozen=True)
class MultiFactor:
    """Equal-weight groups by a weighted mean of z-scores over the whole cross-section."""

    items: dict[str, float]
    n_groups: int = 5

    @property
    def factors(self) -> list[str]:
        return list(self.items)

    def scores(self, cross: DataFrame) -> DataFrame:
        return xsection.composite(cross, self.items).select("ts_code", "trade_date", "value")

    def weights(self, scored: DataFrame) -> DataFrame:
        return SingleFactor("value", self.n_groups).weights(scored)


def daily_returns(bars: DataFrame) -> DataFrame:
    """(ts_code, trade_date, ret) on the adjusted close; the first bar of a code has none."""
    close = adjusted(F.col("close"), F.col("adj_factor"))
    r = bars.select("ts_code", "trade_date", simple_return(close).alias("ret"))
    return r.where(F.col("ret").isNotNull())


def numbered(rebalances: DataFrame) -> DataFrame:
    """(trade_date, rebalance_no, next_date); the last date has no next and only closes the one before."""
    w = Window.orderBy("trade_date")  # one row per rebalance date
    return rebalances.select(
        "trade_date", F.row_number().over(w).cast("long").alias("rebalance_no"), F.lead("trade_date").over(w).alias("next_date")
    )


def holding_days(rebalances: DataFrame, opens: DataFrame) -> DataFrame:
    """Every open day with the rebalance it belongs to: (trade_date of the rebalance, rebalance_no, day, day_no).

    A day belongs to the last rebalance strictly before it: a running maximum over the calendar.
    """
    reb = numbered(rebalances)
    marks = opens.select(F.col("trade_date").alias("day")).distinct().join(
        reb.select(F.col("trade_date").alias("day"), F.col("rebalance_no").alias("_no")), "day", "left"
    )
    prior = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    placed = marks.select("day", F.max("_no").over(prior).alias("rebalance_no")).where(F.col("rebalance_no").isNotNull())
    closed = reb.where(F.col("next_date").isNotNull()).select("trade_date", "rebalance_no")
    first = Window.partitionBy("rebalance_no").orderBy("day")
    return placed.join(closed, "rebalance_no").withColumn("day_no", F.row_number().over(first))


def period_returns(rets: DataFrame, days: DataFrame) -> DataFrame:
    """Compounded return of each code over each holding period; days without a return are left out."""
    r = rets.select("ts_code", F.col("trade_date").alias("day"), "ret")
    r = r.join(days.select("trade_date", "rebalance_no", "day"), "day")
    return r.groupBy("trade_date", "rebalance_no", "ts_code").agg((F.product(F.lit(1.0) + F.col("ret")) - 1.0).alias("period_return"))


@dataclass(frozen=True)
class Schedule:
    """The open days of a run and its rebalance dates, in order. A calendar is some 250 days a year, so the driver holds it,
    and what depends on days alone is planned from literals and small local tables."""

    spark: SparkSession
    opens: list[str]
    dates: list[str]

    @staticmethod
    def of(opens: DataFrame, freq: str) -> Schedule:
        rows = opens.select("trade_date", spine.period_of(F.col("trade_date"), freq).alias("period")).distinct().collect()
        last: dict[str, str] = {}
        for r in rows:
            last[r.period] = max(r.trade_date, last.get(r.period, ""))
        return Schedule(opens.sparkSession, sorted({r.trade_date for r in rows}), sorted(last.values()))

    @property
    def opening(self) -> list[str]:
        """The dates that open a period; the last one only closes the one before."""
        return self.dates[:-1]

    def number(self, day: Column) -> Column:
        """The number of the period that a rebalance date opens, from 1."""
        return F.array_position(F.lit(self.opening), day).cast("long")

    def rebalances(self) -> DataFrame:
        rows = [(d, i, n) for i, (d, n) in enumerate(zip(self.dates, self.dates[1:]), 1)]
        return self.spark.createDataFrame(rows, "trade_date string, rebalance_no long, next_date string")

    def days(self) -> DataFrame:
        """Every open day with the period it belongs to, as `holding_days` gives it."""
        rows, at, in_period = [], 0, 0
        for day in self.opens:
            if at < len(self.dates) and at and day <= self.dates[at]:
                in_period += 1
                rows.append((self.dates[at - 1], at, day, in_period))
            if at < len(self.dates) and day == self.dates[at]:
                at, in_period = at + 1, 0
        return self.spark.createDataFrame(rows, "trade_date string, rebalance_no long, day string, day_no int")


# Columns that a run reads of the bars.
BAR_COLUMNS = ("ts_code", "trade_date", "close", "adj_factor", "up_limit", "down_limit")


class Backtest:
    """One run. Each output is planned when it is asked for; what several outputs read is staged once.

    `factors` is wide: ts_code, trade_date and the strategy's factor columns. The first day of the range has no
    return, the last rebalance date closes the last period, and a date without a cross-section holds nothing.

    A range that is none, missing columns, fewer than two rebalances and no bars in the range are errors.
    """

    def __init__(
        self,
        bars: DataFrame,
        factors: DataFrame,
        listing: DataFrame,
        calendar: DataFrame,
        suspend: DataFrame,
        strategy: Strategy,
        start: str,
        end: str,
        freq: str = "monthly",
        rates: CostRates = CostRates(),
    ) -> None:
        if not start or not end or start > end:
            raise ValueError(f"no such range: {start!r} to {end!r}")
        for what, frame, need in (("bars", bars, BAR_COLUMNS), ("factors", factors, ("ts_code", "trade_date", *strategy.factors))):
            absent = [c for c in need if c not in frame.columns]
            if absent:
                raise ValueError(f"{what} lack the columns {absent}")
        self.factors, self.listing, self.suspend = factors, listing, suspend
        self.strategy, self.freq, self.rates = strategy, freq, rates
        self.bars = bars.where(F.col("trade_date").between(start, end))
        self.schedule = Schedule.of(spine.open_dates(calendar, start, end), freq)
        self.groups = [f"G{i}" for i in range(strategy.n_groups)]
        if len(self.schedule.dates) < 2:
            raise ValueError(f"fewer than two rebalances from {start} to {end}")
        if self.bars.isEmpty():
            raise ValueError(f"no bars from {start} to {end}")

    @cached_property
    def rebalances(self) -> DataFrame:
        """(trade_date, rebalance_no, next_date) of the dates that open a period."""
        return self.schedule.rebalances()

    @cached_property
    def days(self) -> DataFrame:
        return self.schedule.days()

    @cached_property
    def rets(self) -> DataFrame:
        return stage(daily_returns(self.bars))

    @cached_property
    def cross(self) -> DataFrame:
        """Cross-sections of the rebalance dates: rows that have the first factor."""
        day = F.col("trade_date")
        at = self.factors.where(day.isin(self.schedule.opening)).withColumn("rebalance_no", self.schedule.number(day))
        return stage(at.where(F.col(self.strategy.factors[0]).isNotNull()))

    @cached_property
    def used(self) -> DataFrame:
        """Rebalances with a cross-section; a change after one without is no sale and no trade. As many as the calendar has."""
        rows = self.cross.select("trade_date", "rebalance_no").distinct().collect()
        return self.schedule.spark.createDataFrame(rows, "trade_date string, rebalance_no long")

    @cached_property
    def scored(self) -> DataFrame:
        """Scores over the whole cross-section, then the investable part of it. Only notices of rebalance dates are read."""
        notices = self.suspend.where(F.col("trade_date").isin(self.schedule.opening))
        return stage(universe.investable(self.strategy.scores(self.cross), self.listing, notices))

    @cached_property
    def held(self) -> DataFrame:
        hit = limit_hit(F.col("close"), F.col("up_limit"), F.col("down_limit"))
        day = F.col("trade_date")
        blocked = self.bars.where(day.isin(self.schedule.opening) & hit).select("ts_code", "trade_date")
        targets = self.strategy.weights(self.scored).join(blocked, ["ts_code", "trade_date"], "left_anti")
        return stage(portfolio.renormalise(targets).withColumn("rebalance_no", self.schedule.number(day)))

    @cached_property
    def changes(self) -> DataFrame:
        deltas = portfolio.holdings_delta(self.held.select("rebalance_no", "group_id", "ts_code", "weight"), self.rates)
        return stage(deltas.join(self.used, "rebalance_no"))

    @cached_property
    def by_group(self) -> DataFrame:
        return portfolio.turnover_by_group(self.changes, self.rates)

    @property
    def portfolio(self) -> DataFrame:
        return self.held.select("trade_date", "group_id", "ts_code", "weight")

    @property
    def trades(self) -> DataFrame:
        return self.changes.select("trade_date", "group_id", "ts_code", "delta_weight", "cost")

    @cached_property
    def turnover(self) -> DataFrame:
        per_date = portfolio.average_turnover(self.by_group, len(self.groups))
        rows = self.used.join(per_date, "rebalance_no", "left")
        return stage(rows.select("trade_date", F.coalesce(F.col("turnover"), F.lit(0.0)).alias("turnover")))

    @cached_property
    def ic(self) -> DataFrame:
        fwd = period_returns(self.rets, self.days).select("trade_date", "ts_code", "period_return")
        pairs = stage(self.scored.select("trade_date", "ts_code", "value").join(fwd, ["trade_date", "ts_code"]))
        measured = xsection.information_coefficient(pairs, "value", "period_return")
        return stage(self.used.select("trade_date").join(measured, "trade_date", "left"))

    @cached_property
    def returns(self) -> DataFrame:
        return stage(group_returns(self.held, self.rets, self.days, self.by_group, self.used, self.groups))


def group_returns(held: DataFrame, rets: DataFrame, days: DataFrame, by_group: DataFrame, used: DataFrame, groups: list[str]) -> DataFrame:
    """Daily return of every group and of first less last: weight times return, a missing return counting 0, the
    cost of the rebalance on its first day. Weights do not drift within a period.

    Returns are placed in their period first and meet the holdings on (period, code); the days themselves are the
    spine, so a day without any return is 0.
    """
    placed = rets.select("ts_code", F.col("trade_date").alias("day"), "ret").join(
        days.select("rebalance_no", "day", "day_no"), "day"
    )
    earned = (
        placed.join(held.select("rebalance_no", "group_id", "ts_code", "weight"), ["rebalance_no", "ts_code"])
        .groupBy("day")
        .agg(*[F.sum(F.when(F.col("group_id") == g, F.col("weight") * F.col("ret"))).alias(g) for g in groups])
    )
    costs = by_group.groupBy("rebalance_no").agg(*[F.max(F.when(F.col("group_id") == g, F.col("cost"))).alias(f"_c_{g}") for g in groups])
    frame = (
        days.join(used.select("rebalance_no"), "rebalance_no", "left_semi")
        .select("rebalance_no", "day", "day_no")
        .join(earned, "day", "left")
        .join(costs, "rebalance_no", "left")
    )
    zero = F.lit(0.0)
    net = {
        g: F.coalesce(F.col(g), zero) - F.when(F.col("day_no") == 1, F.coalesce(F.col(f"_c_{g}"), zero)).otherwise(zero)
        for g in groups
    }
    wide = frame.select(F.col("day").alias("trade_date"), *[c.alias(g) for g, c in net.items()])
    return wide.withColumn("long_short", F.col(groups[0]) - F.col(groups[-1]))


def quality_warnings(bars: DataFrame, rets: DataFrame, n_rebalances: int, n_days: int) -> DataFrame:
    """(warning, value, trade_date): few rebalances, few days, the first day whose upper median return is beyond 20%,
    a share of missing factors beyond 5%."""
    spark = bars.sparkSession
    schema = "warning string, value double, trade_date string"
    fixed = []
    if n_rebalances < MIN_REBALANCES:
        fixed.append(("few_rebalances", float(n_rebalances), None))
    if n_days < MIN_DAYS:
        fixed.append(("few_days", float(n_days), None))
    medians = ordering.upper_median(rets, "ret", ["trade_date"])
    jump = (
        medians.where(F.abs("median") > MAX_MEDIAN_RETURN)
        .orderBy("trade_date")
        .limit(1)
        .select(F.lit("median_return").alias("warning"), F.col("median").alias("value"), "trade_date")
    )
    share = bars.agg((F.count_if(F.col("adj_factor").isNull()) / F.count(F.lit(1))).alias("value"))
    nulls = share.where(F.col("value") > MAX_NULL_SHARE).select(
        F.lit("adj_factor_nulls").alias("warning"), "value", F.lit(None).cast("string").alias("trade_date")
    )
    return spark.createDataFrame(fixed, schema).union(jump).union(nulls)


def summary(result: Backtest, labels: dict[str, str] | None = None) -> DataFrame:
    """One row: IC means and ratios, mean turnover, metrics of long-short, Sharpe of the top group."""
    ls = series.return_metrics(result.returns, "long_short")
    top = series.return_metrics(result.returns, result.groups[0]).select("sharpe")
    turn = result.turnover.agg(F.avg("turnover").alias("avg_turnover"), F.count(F.lit(1)).alias("n_rebalance"))
    row = lambda df: df.select(F.struct(*df.columns)).scalar()  # noqa: E731  (one row each)
    out = xsection.ic_summary(result.ic).withColumns({"_ls": row(ls), "_turn": row(turn), "top_group_sharpe": top.scalar()})
    return out.select(
        "ic_mean", "rank_ic_mean", "icir", "rank_icir", "_ls.*", "top_group_sharpe", "_turn.*",
        *[F.lit(v).alias(k) for k, v in (labels or {}).items()],
    )
