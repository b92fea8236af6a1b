"""L: sorts, limits, pages, below-threshold listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.aggregates import A6_SQL, bar_snapshot
from barloom.catalog.joins import FACTORS_SQL, LISTED_SQL, factors_long
from barloom.catalog.registry import query
from barloom.catalog.spines import PERIOD_SPINE, order_range
from barloom.catalog.views import bars_d, bars_m, calendar, companies, landing, report_quarters, reports, with_views
from barloom.operators import completeness, profile, spine
from barloom.plans import completeness_jobs as jobs
from barloom.plans import hot_table


@query(
    "l1_recent_dates",
    with_views("bars_d", "SELECT trade_date FROM (SELECT DISTINCT trade_date FROM bars_d ORDER BY 1 DESC LIMIT 60) ORDER BY 1"),
)
def _(spark, sf):
    return hot_table.recent_dates(bars_d(spark, sf), 60)


def _page_sql(key: str, page: int, size: int, src: str) -> str:
    return f"""SELECT min({key}) AS lo, max({key}) AS hi, count(*) AS n FROM
      (SELECT {key}, row_number() OVER (ORDER BY {key} DESC) AS i FROM {src}) WHERE i BETWEEN {(page - 1) * size + 1} AND {page * size}"""


@query("l2_page_periods", PERIOD_SPINE + _page_sql("end_date", 2, 4, "per"))
def _(spark, sf):
    return spine.newest_first_page(spine.report_periods_of(order_range(spark, sf)), "end_date", 2, 4)


_SPAN = "b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)"


@query(
    "l2b_page_months",
    f"WITH {_SPAN}, m AS (SELECT strftime(unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 MONTH)), '%Y%m') AS month FROM b) "
    + _page_sql("month", 3, 12, "m"),
)
def _(spark, sf):
    return spine.newest_first_page(spine.months_of(order_range(spark, sf)), "month", 3, 12)


@query("l2c_page_open_dates", with_views("calendar", _page_sql("cal_date", 3, 50, "calendar WHERE is_open = '1'").replace("cal_date) AS lo", "cal_date) AS lo")))
def _(spark, sf):
    return spine.newest_first_page(spine.open_dates(calendar(spark, sf)), "trade_date", 3, 50)


@query(
    "l2d_page_days",
    f"WITH {_SPAN}, d AS (SELECT strftime(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)), '%Y%m%d') AS date_key FROM b) "
    + _page_sql("date_key", 2, 31, "d"),
)
def _(spark, sf):
    return spine.newest_first_page(spine.calendar_days_of(order_range(spark, sf)), "date_key", 2, 31)


@query(
    "l4_below_ratio",
    with_views(
        "listing suspend calendar bars_d",
        A6_SQL
        + """SELECT trade_date AS date_key, period_stock_count, kline_daily_count AS resolved_count FROM snap
        WHERE period_stock_count > 0 AND kline_daily_count::DOUBLE / period_stock_count < 0.3""",
    ),
)
def _(spark, sf):
    s = bar_snapshot(spark, sf).select(
        F.col("trade_date").alias("date_key"), "period_stock_count", F.col("kline_daily_count").alias("resolved_count")
    )
    return completeness.below_ratio(s, 0.3).orderBy("date_key")


@query(
    "l5_below_share_days",
    with_views(
        "listing suspend calendar bars_d",
        A6_SQL
        + """SELECT trade_date, kline_adj_factor_count FROM snap
        WHERE period_stock_count > 0 AND kline_adj_factor_count < 0.25::DOUBLE * period_stock_count""",
    ),
)
def _(spark, sf):
    below = completeness.below_share(bar_snapshot(spark, sf), "kline_adj_factor_count", "period_stock_count", 0.25)
    return below.select("trade_date", "kline_adj_factor_count").orderBy(F.desc("trade_date"))


@query(
    "l6_below_share_periods",
    with_views(
        "reports companies",
        f"""& per AS (SELECT DISTINCT end_date FROM reports WHERE end_date >= '2005' OR substr(end_date, 5) IN ('0630', '1231')),
        c AS (SELECT end_date, count(*) FILTER (report_type = '1') AS income_count FROM reports GROUP BY 1),
        lc AS (SELECT p.end_date, count(l.ts_code) AS listed_count FROM per p
           LEFT JOIN companies l ON {LISTED_SQL.format(l='l', d='p.end_date')} GROUP BY 1)
        SELECT end_date, income_count, listed_count FROM lc JOIN c USING (end_date)
        WHERE listed_count > 0 AND income_count < 0.95::DOUBLE * listed_count AND end_date BETWEEN '19960101' AND '20001231'""",
    ),
)
def _(spark, sf):
    q = report_quarters(spark, sf)
    due = spine.report_periods(spark, "19960101", "20001231")
    counts = jobs.report_completeness(completeness.period_counts(q, {"income": F.col("n1")}), companies(spark, sf, q), due)
    counts = counts.join(q.select("end_date").distinct(), "end_date", "left_semi")
    return completeness.below_share(counts, "income_count", "listed_count").select(
        "end_date", "income_count", "listed_count"
    ).orderBy(F.desc("end_date"))


@query(
    "l7_last_quote",
    with_views(
        "bars_d",
        """& q AS (SELECT ts_code, trade_date, close, lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) AS pre_close FROM bars_d)
        SELECT ts_code, trade_date, close, pre_close, round(close / pre_close - 1.0::DOUBLE, 6) AS change_pct FROM q
        QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1""",
    ),
)
def _(spark, sf):
    q = profile.last_quote(bars_d(spark, sf))
    return q.withColumn("change_pct", F.round("change_pct", 6))


@query(
    "l8_bars_with_factor",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """SELECT b.trade_date, b.close, round(f.value, 8) AS factor FROM bars_m b
        LEFT JOIN factors f ON f.ts_code = b.ts_code AND f.trade_date = b.trade_date AND f.factor_name = 'volume'
        WHERE b.ts_code LIKE '%000000000007.SZ' AND b.trade_date BETWEEN '19960101' AND '20001231'""",
    ),
)
def _(spark, sf):
    from barloom.sources import bars as B

    one = bars_m(spark, sf).where(F.col("ts_code").endswith("000000000007.SZ") & F.col("trade_date").between("19960101", "20001231"))
    o = B.with_factor(one, factors_long(spark, sf), "volume")
    return o.select("trade_date", "close", F.round("factor", 8).alias("factor"))


@query(
    "l10_snapshot_lookup",
    with_views(
        "landing",
        """SELECT source AS source_name, trade_date AS date_key, count(*) AS resolved_count FROM landing
        WHERE source IN ('view', 'click') AND trade_date BETWEEN '20240105' AND '20240120' GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    from barloom.operators import filters

    snaps = landing(spark, sf).groupBy(F.col("source").alias("source_name"), F.col("trade_date").alias("date_key")).agg(
        F.count(F.lit(1)).alias("resolved_count")
    )
    hit = filters.where_in(filters.where_between(snaps, "date_key", "20240105", "20240120"), "source_name", ["view", "click"])
    return hit.orderBy("date_key", "source_name")
