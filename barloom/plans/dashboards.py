"""Completeness dashboards: date spines against source columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import completeness

DEFAULT_THRESHOLD = completeness.THRESHOLD


@dataclass(frozen=True)
class DashColumn:
    """A source: read from live counts (`counted`), from snapshots, or (`pulled_only`) from neither."""

    key: str
    label: str
    threshold: float = DEFAULT_THRESHOLD
    counted: bool = False
    pulled_only: bool = False


@dataclass(frozen=True)
class DashGroup:
    group_id: str
    title: str
    key_type: str
    columns: tuple[DashColumn, ...]


def _group(group_id: str, title: str, key_type: str, *columns: DashColumn) -> DashGroup:
    return DashGroup(group_id, title, key_type, columns)


# The groups, their sources and the thresholds that differ from the default.
GROUPS = {
    g.group_id: g
    for g in (
        _group(
            "financial_report_period", "财务类 / 报告期", "report_period",
            DashColumn("report_income", "利润表", counted=True),
            DashColumn("report_balance", "资产负债表", counted=True),
            DashColumn("report_cashflow", "现金流量表", counted=True),
            DashColumn("report_indicator", "财务指标", counted=True),
            DashColumn("financial_forecast", "业绩预告"),
            DashColumn("financial_express", "业绩快报"),
            DashColumn("financial_audit", "审计意见"),
            DashColumn("financial_disclosure_date", "披露计划"),
            DashColumn("financial_fina_mainbz", "主营构成"),
        ),
        _group(
            "financial_ann_date", "财务类 / 公告日", "ann_date",
            DashColumn("financial_stock_holder", "股东户数"),
            DashColumn("financial_shareholder_top10", "前十大股东"),
            DashColumn("financial_top10_floatholders", "前十大流通股东"),
        ),
        _group(
            "kline_trade_date", "K线类 / 交易日", "trade_date",
            DashColumn("kline_daily", "日K", counted=True),
            DashColumn("kline_adj_factor", "复权因子", counted=True),
            DashColumn("kline_stk_limit", "涨跌停", counted=True),
            DashColumn("kline_stock_factor", "技术因子"),
        ),
        _group(
            "market_trade_date", "市场类 / 交易日", "trade_date",
            DashColumn("market_daily_basic", "每日指标"),
            DashColumn("market_moneyflow", "资金流向", 0.92),
            DashColumn("market_margin_detail", "融资融券"),
            DashColumn("market_northbound_top10", "北向十大"),
            DashColumn("market_moneyflow_hsgt", "沪深港通资金"),
            DashColumn("market_hk_hold", "港股通持股"),
            DashColumn("market_block_trade", "大宗交易"),
            DashColumn("dragon_tiger", "龙虎榜"),
        ),
        _group(
            "index_month", "指数类 / 月", "month",
            DashColumn("index_weight", "指数权重"),
            DashColumn("index_basic", "指数基本信息", pulled_only=True),
            DashColumn("index_classify", "申万分类", pulled_only=True),
            DashColumn("index_member_all", "申万成分", pulled_only=True),
        ),
        _group("index_trade_date", "指数类 / 交易日", "trade_date", DashColumn("index_daily", "指数日线")),
        _group(
            "stock_basic_trade_date", "基础类 / 交易日", "trade_date",
            DashColumn("stock_suspend", "停复牌", 0.0, counted=True),
            DashColumn("stock_premarket", "盘前股本"),
            DashColumn("stock_share_float", "限售解禁"),
        ),
    )
}


def best_of_month(snapshots: DataFrame) -> DataFrame:
    """Per source and month the snapshot with most resolved rows, keyed by month."""
    best = F.max_by(F.struct("period_stock_count", "resolved_count"), F.struct("resolved_count", F.col("period_stock_count")))
    return (
        snapshots.groupBy("source_name", F.substring("date_key", 1, 6).alias("month"))
        .agg(best.alias("_b"))
        .select("source_name", F.col("month").alias("date_key"), "_b.*")
    )


def cells(group: DashGroup, spine: DataFrame, snapshots: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per date key and source of the group, with the cell's metric and the row's completeness.

    spine: date_key and, where the group compares with listings, period_stock_count; without that column each
    snapshot brings its own. counts: date_key and one column per counted source. The sources are exploded from an
    array on every key, so there is no cross join; snapshots and counts meet the grid in one equi-join.
    """
    own = "period_stock_count" not in spine.columns
    config = F.array(
        *[
            F.struct(
                F.lit(i).alias("column_no"),
                F.lit(c.key).alias("column_key"),
                F.lit(float(c.threshold)).alias("threshold"),
                F.lit(c.counted).alias("counted"),
            )
            for i, c in enumerate(group.columns)
        ]
    )
    grid = spine.select("date_key", *([] if own else ["period_stock_count"]), F.explode(config).alias("c")).select("*", "c.*").drop("c")
    known = snapshots.where(F.col("source_name").isin([c.key for c in group.columns if not (c.counted or c.pulled_only)])).select(
        F.col("source_name").alias("column_key"), "date_key", F.col("resolved_count").alias("_n"), F.col("period_stock_count").alias("_p")
    )
    live = [c.key for c in group.columns if c.counted]
    if live:
        if counts is None:
            raise ValueError(f"group {group.group_id} needs live counts")
        long = counts.unpivot(["date_key"], live, "column_key", "_n").select("column_key", "date_key", "_n", F.lit(None).cast("bigint").alias("_p"))
        known = known.unionByName(long)
    joined = grid.join(known, ["date_key", "column_key"], "left")
    count = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    expected = F.coalesce(F.col("_p") if own else F.col("period_stock_count"), F.lit(0)).cast("bigint")
    has = F.col("counted") | F.col("_n").isNotNull()
    out = joined.select(
        F.lit(group.group_id).alias("group_id"),
        "date_key",
        "column_no",
        "column_key",
        count.alias("count"),
        expected.alias("period_stock_count"),
        "threshold",
        has.alias("has_snapshot"),
    )
    return out.withColumns(completeness.metric(F.col("count"), F.col("period_stock_count"), F.col("threshold"), F.col("has_snapshot")))


def rows(cells_: DataFrame, group: DashGroup) -> DataFrame:
    """The grid as shown: one row per date key, newest first, a ratio per source and the row's completeness."""
    ratio = [F.max(F.when(F.col("column_key") == c.key, F.col("ratio"))).alias(c.key) for c in group.columns]
    return cells_.groupBy("date_key").agg(*ratio, completeness.row_complete().alias("row_complete")).orderBy(F.desc("date_key"))


def gaps(cells_: DataFrame, n: int | None = None) -> DataFrame:
    """Incomplete cells of sources with a threshold, newest first; the first n of them for a report."""
    due = cells_.where((F.col("threshold") > 0) & ~F.col("is_complete"))
    ordered = due.select("group_id", "date_key", "column_key", "ratio", "threshold").orderBy(F.desc("date_key"), "group_id", "column_key")
    return ordered if n is None else ordered.limit(n)


def overview(groups: list[DataFrame]) -> DataFrame:
    """Health of every group: one aggregate over the cells of all of them."""
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return completeness.group_summary(out)
