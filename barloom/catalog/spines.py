"""D: date spines, cut to the range that the given tables span."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import bars_d, calendar, index_m, table, with_views, ymd
from barloom.operators import spine


def order_range(spark, sf):
    """First and last order date: one row (s, e)."""
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").agg(ymd(F.min(d)).alias("s"), ymd(F.max(d)).alias("e"))


_LO_HI = "b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)"
_SERIES = "unnest(generate_series({lo}, {hi}, INTERVAL {step}))"

PERIOD_SPINE = f"""WITH {_LO_HI}, q AS (SELECT strftime(last_day(CAST(d AS DATE)), '%Y%m%d') AS end_date, lo, hi FROM
  (SELECT {_SERIES.format(lo="date_trunc('year', lo) + INTERVAL 2 MONTH", hi="date_trunc('year', hi) + INTERVAL 11 MONTH", step="3 MONTH")} AS d, lo, hi FROM b)),
  per AS (SELECT end_date FROM q WHERE end_date BETWEEN strftime(lo, '%Y%m%d') AND strftime(hi, '%Y%m%d')
    AND (end_date >= '2005' OR substr(end_date, 5) IN ('0630', '1231')))
"""


@query("d1_report_periods", PERIOD_SPINE + "SELECT end_date FROM per")
def _(spark, sf):
    return spine.report_periods_of(order_range(spark, sf))


@query("d7_annual_periods", PERIOD_SPINE + "SELECT end_date FROM per WHERE end_date LIKE '%1231'")
def _(spark, sf):
    return spine.annual_only(spine.report_periods_of(order_range(spark, sf)))


@query(
    "d2_months",
    f"WITH {_LO_HI} SELECT strftime({_SERIES.format(lo=chr(100)+'ate_trunc(' + chr(39) + 'month' + chr(39) + ', lo)', hi='hi::TIMESTAMP', step='1 MONTH')}, '%Y%m') AS month FROM b",
)
def _(spark, sf):
    return spine.months_of(order_range(spark, sf))


@query(
    "d3_calendar_days",
    f"WITH {_LO_HI} SELECT strftime({_SERIES.format(lo='lo::TIMESTAMP', hi='hi::TIMESTAMP', step='1 DAY')}, '%Y%m%d') AS date_key FROM b",
)
def _(spark, sf):
    return spine.calendar_days_of(order_range(spark, sf))


@query(
    "d4_open_dates",
    with_views("calendar", "SELECT cal_date AS trade_date FROM calendar WHERE is_open = '1' AND cal_date BETWEEN '19960101' AND '20001231'"),
)
def _(spark, sf):
    return spine.open_dates(calendar(spark, sf), "19960101", "20001231").orderBy("trade_date")


@query(
    "d5_rebalance_dates",
    with_views(
        "calendar",
        """SELECT max(cal_date) AS trade_date FROM calendar WHERE is_open = '1' AND cal_date BETWEEN '19960115' AND '20001215'
        GROUP BY strftime(strptime(cal_date, '%Y%m%d'), '%G%V')""",
    ),
)
def _(spark, sf):
    return spine.rebalance_dates(calendar(spark, sf), "19960115", "20001215", "weekly")


@query(
    "d6_incremental_start",
    with_views(
        "bars_d",
        """SELECT greatest('19950101', strftime(CAST(strptime(max(trade_date), '%Y%m%d') AS DATE) + 1, '%Y%m%d')) AS start_date FROM bars_d""",
    ),
)
def _(spark, sf):
    return spine.incremental_start(bars_d(spark, sf), "trade_date", "19950101")


@query(
    "d8_coverage_gaps",
    with_views(
        "bars_d",
        """& b AS (SELECT strftime(CAST(strptime(min(trade_date), '%Y%m%d') AS DATE) - 1, '%Y%m%d') AS head_end,
             strftime(CAST(strptime(max(trade_date), '%Y%m%d') AS DATE) + 1, '%Y%m%d') AS tail_start FROM bars_d)
        SELECT 'head' AS part, '19900101' AS gap_start, head_end AS gap_end FROM b WHERE head_end >= '19900101'
        UNION ALL SELECT 'tail', tail_start, '20051231' FROM b WHERE tail_start <= '20051231'""",
    ),
)
def _(spark, sf):
    return spine.coverage_gaps(bars_d(spark, sf), "trade_date", "19900101", "20051231")


@query(
    "d9_incremental_start_month",
    with_views(
        "index_m",
        """SELECT ts_code, greatest('200001', strftime(CAST(strptime(max(substr(trade_date, 1, 6)) || '01', '%Y%m%d') AS DATE) + INTERVAL 1 MONTH, '%Y%m')) AS start_month
        FROM index_m WHERE NOT (ts_code = '000905.SH' AND trade_date > '1998') GROUP BY 1""",
    ),
)
def _(spark, sf):
    i = index_m(spark, sf).where(~((F.col("ts_code") == "000905.SH") & (F.col("trade_date") > "1998")))
    return spine.incremental_start_month(i, "trade_date", "200001", ["ts_code"])
