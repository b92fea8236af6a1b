"""A1-A17, A22-A30: counts, snapshots, metrics and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.joins import FACTORS_SQL, GROUPS_SQL, LISTED_SQL, factors_long, holdings
from barloom.catalog.predicates import FULL_DAY_SQL
from barloom.catalog.registry import query
from barloom.catalog.views import (
    bars_d,
    bars_m,
    calendar,
    code_sql,
    companies,
    index_m,
    landing,
    listing,
    Market,
    market,
    report_quarters,
    reports,
    suspend,
    table,
    with_views,
    ymd,
)
from barloom.operators import completeness, portfolio, profile, registry, series, spine, universe
from barloom.session import scratch_path

# ── counts ───────────────────────────────────────────────────────────────


@query(
    "a1_count_by_date",
    with_views(
        "bars_d",
        "SELECT trade_date AS date_key, count(*) AS resolved_count FROM bars_d WHERE trade_date >= '19960101' GROUP BY 1",
    ),
)
def _(spark, sf):
    b = bars_d(spark, sf).where(F.col("trade_date") >= "19960101")
    return completeness.count_by_key(b, "trade_date").orderBy(F.desc("date_key"))


_BAR_COUNTS = """SELECT trade_date, count(*) AS kline_daily_count, count(adj_factor) AS kline_adj_factor_count,
   count(*) FILTER (up_limit IS NOT NULL AND down_limit IS NOT NULL) AS kline_stk_limit_count FROM bars_d GROUP BY 1"""


@query("a2_conditional_counts", with_views("bars_d", f"SELECT trade_date, kline_daily_count, kline_adj_factor_count FROM ({_BAR_COUNTS})"))
def _(spark, sf):
    return completeness.bar_counts(bars_d(spark, sf)).select("trade_date", "kline_daily_count", "kline_adj_factor_count")


@query("a2b_limit_counts", with_views("bars_d", f"SELECT trade_date, kline_stk_limit_count FROM ({_BAR_COUNTS})"))
def _(spark, sf):
    return completeness.bar_counts(bars_d(spark, sf)).select("trade_date", "kline_stk_limit_count")


_NOT_B = "NOT (l.ts_code LIKE '9009%' OR l.ts_code LIKE '200%')"


def _active_sql(keys: str, name: str = "act") -> str:
    """Listed and trading counts over the keys view `keys`(date_key)."""
    return f""", {name}_l AS (SELECT k.date_key, count(l.ts_code) AS listed_count FROM {keys} k
     LEFT JOIN listing l ON {LISTED_SQL.format(l='l', d='k.date_key')} AND {_NOT_B} GROUP BY 1),
  {name}_s AS (SELECT s.trade_date AS date_key, count(*) AS n FROM
     (SELECT DISTINCT ts_code, trade_date FROM suspend WHERE {FULL_DAY_SQL}) s JOIN listing l ON l.ts_code = s.ts_code
      AND {LISTED_SQL.format(l='l', d='s.trade_date')} AND {_NOT_B} GROUP BY 1),
  {name} AS (SELECT date_key, listed_count,
     CASE WHEN EXISTS (SELECT 1 FROM calendar c WHERE c.cal_date = date_key AND c.is_open = '1')
          THEN listed_count - coalesce(n, 0) END AS trading_count
     FROM {name}_l LEFT JOIN {name}_s USING (date_key))
"""


def active(m: Market, keys):
    """Active counts of the listing over the given keys."""
    return universe.active_counts(m.listing, keys, spine.open_dates(m.calendar), m.suspend)


def open_keys(m: Market):
    return spine.open_dates(m.calendar).select(F.col("trade_date").alias("date_key"))


_ALL_DAYS = "keys AS (SELECT cal_date AS date_key FROM calendar)"
_OPEN_KEYS = "keys AS (SELECT cal_date AS date_key FROM calendar WHERE is_open = '1')"


@query("a3_active_counts", with_views("listing suspend calendar", "& " + _ALL_DAYS + _active_sql("keys") + "SELECT * FROM act"))
def _(spark, sf):
    m = market(spark, sf)
    return active(m, m.calendar.select(F.col("cal_date").alias("date_key")))


@query(
    "a3b_still_listed_counts",
    with_views(
        "listing calendar",
        """SELECT c.cal_date AS trade_date, count(l.ts_code) AS listed_count FROM calendar c LEFT JOIN listing l
        ON l.list_date <> '' AND l.list_date <= c.cal_date AND coalesce(l.delist_date, '') = ''
        WHERE c.is_open = '1' GROUP BY 1""",
    ),
)
def _(spark, sf):
    days = spine.open_dates(calendar(spark, sf))
    return universe.listed_counts(listing(spark, sf), days, "trade_date", skip_b=False, survivors_only=True)


# Report periods from the quarter of the first order to the year end after the last one.
_PERIODS_SQL = """SELECT p AS date_key FROM (SELECT strftime(last_day(CAST(d AS DATE)), '%Y%m%d') AS p FROM
   (SELECT unnest(generate_series(date_trunc('quarter', lo) + INTERVAL 2 MONTH, date_trunc('year', hi) + INTERVAL 11 MONTH, INTERVAL 3 MONTH)) AS d
    FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)))
   WHERE p >= '2005' OR substr(p, 5) IN ('0630', '1231')"""
# What each statement adds to a period's count, over `report_quarters`.
STATEMENTS = {n: f"n{t}" for n, t in zip(("income", "balance", "cashflow", "indicator"), "1234")}


def statements():
    """The same as columns, which need a session."""
    return {n: F.col(c) for n, c in STATEMENTS.items()}


def due_periods(spark, sf):
    d = F.to_date("o_orderdate")
    span = table(spark, sf, "orders").agg(ymd(F.min(F.trunc(d, "quarter"))).alias("s"), F.concat(F.date_format(F.max(d), "yyyy"), F.lit("1231")).alias("e"))
    return spine.report_periods_of(span)


@query(
    "a4_active_count_keys",
    with_views(
        "listing suspend calendar",
        f"& keys AS (SELECT cal_date AS date_key FROM calendar WHERE is_open = '1' UNION {_PERIODS_SQL})"
        + _active_sql("keys")
        + "SELECT * FROM act",
    ),
)
def _(spark, sf):
    m = market(spark, sf)
    return active(m, open_keys(m).union(due_periods(spark, sf).select(F.col("end_date").alias("date_key"))).distinct())


@query(
    "a5_denominator",
    with_views(
        "listing suspend calendar",
        "& " + _OPEN_KEYS + _active_sql("keys")
        + f""", p AS (SELECT date_key AS day FROM ({_PERIODS_SQL}) UNION SELECT '19900101')
        SELECT p.day, coalesce(a.trading_count, 0) AS expected FROM p ASOF LEFT JOIN act a ON p.day >= a.date_key""",
    ),
)
def _(spark, sf):
    m = market(spark, sf)
    p = due_periods(spark, sf).select(F.col("end_date").alias("day")).union(spark.range(1).select(F.lit("19900101")))
    return universe.denominators(p, "day", active(m, open_keys(m)), spine.open_dates(m.calendar))


A6_SQL = (
    "& " + _OPEN_KEYS + _active_sql("keys")
    + f""", bc AS ({_BAR_COUNTS}),
  snap AS (SELECT a.date_key AS trade_date, a.trading_count AS period_stock_count,
     coalesce(kline_daily_count, 0) AS kline_daily_count, coalesce(kline_adj_factor_count, 0) AS kline_adj_factor_count,
     coalesce(kline_stk_limit_count, 0) AS kline_stk_limit_count FROM act a LEFT JOIN bc ON a.date_key = bc.trade_date)
"""
)


def bar_snapshot(spark, sf):
    from barloom.plans.completeness_jobs import bar_completeness

    m = market(spark, sf, bars=True)
    return bar_completeness(m.bars, m.listing, m.calendar, m.suspend)


@query("a6_bar_completeness", with_views("listing suspend calendar bars_d", A6_SQL + "SELECT * FROM snap"))
def _(spark, sf):
    return bar_snapshot(spark, sf)


_A7_PERIODS = "per AS (SELECT date_key AS end_date FROM (" + _PERIODS_SQL + "))"


@query(
    "a7_report_completeness",
    with_views(
        "reports companies",
        f"""& {_A7_PERIODS},
        c AS (SELECT end_date, count(*) FILTER (report_type = '1') AS income_count, count(*) FILTER (report_type = '2') AS balance_count,
           count(*) FILTER (report_type = '3') AS cashflow_count, count(*) FILTER (report_type = '4') AS indicator_count
           FROM reports GROUP BY 1),
        lc AS (SELECT p.end_date, count(l.ts_code) AS listed_count FROM per p
           LEFT JOIN companies l ON {LISTED_SQL.format(l='l', d='p.end_date')} GROUP BY 1)
        SELECT end_date, listed_count, coalesce(income_count, 0) AS income_count, coalesce(balance_count, 0) AS balance_count,
           coalesce(cashflow_count, 0) AS cashflow_count, coalesce(indicator_count, 0) AS indicator_count
        FROM lc LEFT JOIN c USING (end_date)""",
    ),
)
def _(spark, sf):
    from barloom.plans.completeness_jobs import report_completeness

    q = report_quarters(spark, sf)
    return report_completeness(completeness.period_counts(q, statements()), companies(spark, sf, q), due_periods(spark, sf))


@query(
    "a8_snapshot",
    with_views(
        "listing suspend calendar bars_d",
        A6_SQL
        + """SELECT 'kline_daily' AS source_name, trade_date AS date_key, period_stock_count, kline_daily_count AS resolved_count
        FROM snap""",
    ),
)
def _(spark, sf):
    m = market(spark, sf, bars=True)
    expected = active(m, open_keys(m)).select("date_key", F.col("trading_count").alias("expected"))
    return completeness.snapshot("kline_daily", expected, completeness.count_by_key(m.bars, "trade_date"))


_STICKY_SQL = """& keys AS (SELECT DISTINCT trade_date AS date_key FROM landing),
  act AS (SELECT trade_date AS date_key, count(*) AS n FROM landing WHERE source = 'purchase' GROUP BY 1),
  prev AS (SELECT trade_date AS date_key, least(count(*), 1) AS n FROM landing WHERE source = 'error' GROUP BY 1)
"""


def _sticky_inputs(spark, sf):
    la = landing(spark, sf)
    keys = la.select(F.col("trade_date").alias("date_key")).distinct()
    actual = completeness.count_by_key(la.where("source = 'purchase'"), "trade_date")
    prev = completeness.count_by_key(la.where("source = 'error'"), "trade_date").select(
        F.lit("purchases").alias("source_name"),
        "date_key",
        F.lit(1).cast("bigint").alias("period_stock_count"),
        F.least("resolved_count", F.lit(1).cast("bigint")).alias("resolved_count"),
    )
    return keys, actual, prev


@query(
    "a9_sticky_snapshot",
    with_views(
        "landing",
        _STICKY_SQL
        + """SELECT 'purchases' AS source_name, date_key, CAST(1 AS BIGINT) AS period_stock_count,
          CAST(CASE WHEN coalesce(act.n, 0) >= 1 THEN act.n WHEN coalesce(prev.n, 0) >= 1 THEN 1 ELSE 0 END AS BIGINT) AS resolved_count
        FROM keys LEFT JOIN act USING (date_key) LEFT JOIN prev USING (date_key)""",
    ),
)
def _(spark, sf):
    return completeness.sticky_snapshot("purchases", *_sticky_inputs(spark, sf))


@query(
    "a9b_mark_pulled",
    with_views(
        "landing",
        _STICKY_SQL
        + """, s AS (SELECT 'purchases' AS source_name, date_key, CAST(1 AS BIGINT) AS period_stock_count,
          CAST(coalesce(act.n, 0) AS BIGINT) AS resolved_count FROM keys LEFT JOIN act USING (date_key))
        SELECT source_name, date_key, period_stock_count, CASE WHEN date_key > '20240115' THEN 1 ELSE resolved_count END AS resolved_count
        FROM s""",
    ),
)
def _(spark, sf):
    keys, actual, _prev = _sticky_inputs(spark, sf)
    one = keys.withColumn("expected", F.lit(1))
    snap = completeness.snapshot("purchases", one, actual)
    return completeness.mark_pulled(snap, "purchases", keys.where("date_key > '20240115'"))


@query(
    "a10_rows_per_key",
    "SELECT replace(strftime(CAST(ts AS DATE), '%Y-%m-%d'), '-', '') AS date_key, count(*) AS resolved_count FROM events GROUP BY 1",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("ann_date"))
    return completeness.count_by_key(e, "ann_date")


@query(
    "a11_peak_universe",
    with_views(
        "landing",
        """SELECT max(n) AS peak FROM (SELECT trade_date, count(DISTINCT ts_code) AS n FROM landing
        WHERE trade_date <= '20240120' GROUP BY 1)""",
    ),
)
def _(spark, sf):
    return completeness.peak_universe(landing(spark, sf), "trade_date", "20240120")


@query(
    "a11b_sketched_universe",
    with_views(
        "landing",
        """SELECT 'day' AS unit, trade_date AS key, count(DISTINCT ts_code) AS n_codes, true AS within FROM landing GROUP BY 2
        UNION ALL SELECT 'month', substr(trade_date, 1, 6), count(DISTINCT ts_code), true FROM landing GROUP BY 2
        UNION ALL SELECT 'year', substr(trade_date, 1, 4), count(DISTINCT ts_code), true FROM landing GROUP BY 2""",
    ),
)
def _(spark, sf):
    """Stored daily sketches merge to months and years; each estimate lies within four standard errors of the exact count."""
    la = landing(spark, sf).select("ts_code", "trade_date")
    path = scratch_path(spark, "sketches")
    completeness.daily_sketches(la, "trade_date").write.parquet(path)
    stored, parts = spark.read.parquet(path), []
    for unit, n in (("day", 8), ("month", 6), ("year", 4)):
        key = F.substring("trade_date", 1, n)
        estimate = completeness.sketched_counts(completeness.merged_sketches(stored, key, "key")).withColumnRenamed("n_codes", "_e")
        exact = la.select(key.alias("key"), "ts_code").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_codes"))
        bound = 4 * 1.04 / 2 ** (completeness.SKETCH_LG / 2) * F.col("n_codes") + 1
        parts.append(exact.join(estimate, "key").select(F.lit(unit).alias("unit"), "key", "n_codes", (F.abs(F.col("_e") - F.col("n_codes")) <= bound).alias("within")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "a12_macro_scan",
    with_views(
        "bars_m",
        """& c AS (SELECT trade_date, count(*) AS n, max(cap) AS e FROM bars_m, (SELECT count(DISTINCT ts_code) AS cap FROM bars_m) GROUP BY 1)
        SELECT count(*) FILTER (n >= floor(0.95 * e)) AS pass_days, count(*) FILTER (n < floor(0.95 * e)) AS fail_days,
          CAST(coalesce(sum(floor(0.95 * e) - n) FILTER (n < floor(0.95 * e)), 0) AS BIGINT) AS missing_records,
          max_by(e, trade_date) AS active_stock FROM c""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf)
    cap = b.select("ts_code").distinct().agg(F.count(F.lit(1))).scalar()
    c = b.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n")).withColumn("e", cap)
    return completeness.macro_scan(c, "n", "e", "trade_date")


# ── profiles ─────────────────────────────────────────────────────────────


@query("a13_last_date_per_code", with_views("bars_d", "SELECT ts_code, max(trade_date) AS last_date FROM bars_d GROUP BY 1"))
def _(spark, sf):
    return profile.last_date_per_code(bars_d(spark, sf))


@query("a13c_last_date", with_views("bars_d", "SELECT max(trade_date) AS last_date FROM bars_d"))
def _(spark, sf):
    return bars_d(spark, sf).agg(F.max("trade_date").alias("last_date"))


@query(
    "a13b_suspension_counts",
    with_views(
        "suspend calendar",
        """SELECT trade_date, count(*) AS n_rows FROM suspend
        WHERE trade_date IN (SELECT cal_date FROM calendar WHERE is_open = '1') GROUP BY 1""",
    ),
)
def _(spark, sf):
    s = suspend(spark, sf).join(spine.open_dates(calendar(spark, sf)), "trade_date", "left_semi")
    return s.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "a14_delist_backfill",
    with_views(
        "listing bars_d",
        """& b AS (SELECT ts_code, max(trade_date) AS last_date FROM bars_d WHERE right(ts_code, 2) <> 'BJ' GROUP BY 1)
        SELECT l.ts_code, l.name, l.delist_date AS delist_before, b.last_date AS delist_after,
          CASE WHEN b.last_date IS NULL THEN 'no_bars' WHEN l.delist_date IS NOT DISTINCT FROM b.last_date THEN 'unchanged'
               ELSE 'updated' END AS outcome
        FROM listing l LEFT JOIN b USING (ts_code) WHERE contains(l.name, '(退)') OR contains(l.fullname, '(退)')""",
    ),
)
def _(spark, sf):
    b = bars_d(spark, sf).where(F.right("ts_code", F.lit(2)) != "BJ")
    return profile.delist_backfill(listing(spark, sf), b)


@query("a15_month_counts", with_views("bars_d", "SELECT substr(trade_date, 1, 6) AS month, count(*) AS n_rows FROM bars_d GROUP BY 1"))
def _(spark, sf):
    return profile.month_counts(bars_d(spark, sf))


@query(
    "a16_factor_coverage",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """SELECT factor_name, min(trade_date) AS start_date, max(trade_date) AS end_date,
          count(DISTINCT substr(trade_date, 1, 6)) AS month_count FROM factors GROUP BY 1""",
    ),
)
def _(spark, sf):
    return profile.factor_coverage(factors_long(spark, sf))


@query(
    "a17_feature_coverage",
    with_views(
        "bars_d index_m",
        """SELECT 'kline_daily' AS table_name, count(*) AS n_rows, min(trade_date) AS min_date, max(trade_date) AS max_date FROM bars_d
        UNION ALL SELECT 'index_daily', count(*), min(trade_date), max(trade_date) FROM index_m""",
    ),
)
def _(spark, sf):
    return profile.table_profile(
        {"kline_daily": (bars_d(spark, sf), "trade_date"), "index_daily": (index_m(spark, sf), "trade_date")}
    )


@query(
    "a30_table_baseline",
    with_views(
        "landing reports suspend",
        """SELECT 'landing' AS table_name, count(*) AS n_rows, min(trade_date) AS min_date, max(trade_date) AS max_date FROM landing
          WHERE trade_date BETWEEN '19960101' AND '20240120'
        UNION ALL SELECT 'reports', count(*), min(ann_date), max(ann_date) FROM reports WHERE ann_date BETWEEN '19960101' AND '20240120'
        UNION ALL SELECT 'suspend', count(*), min(trade_date), max(trade_date) FROM suspend
          WHERE trade_date BETWEEN '19960101' AND '20240120'""",
    ),
)
def _(spark, sf):
    return profile.table_profile(
        {
            "landing": (landing(spark, sf), "trade_date"),
            "reports": (reports(spark, sf), "ann_date"),
            "suspend": (suspend(spark, sf), "trade_date"),
        },
        "19960101",
        "20240120",
    )


# ── return metrics ───────────────────────────────────────────────────────

RETURNS_SQL = """& r AS (SELECT trade_date, round(avg(close / open - 1.0::DOUBLE), 8) * 0.01::DOUBLE - 0.002::DOUBLE AS r
   FROM bars_d GROUP BY 1)
"""


def daily_series(spark, sf):
    return bars_d(spark, sf).groupBy("trade_date").agg(
        (F.round(F.avg(F.col("close") / F.col("open") - 1.0), 8) * 0.01 - 0.002).alias("r")
    )


def _metrics_sql(part: str) -> str:
    by = f"{part} AS year, " if part else ""
    over = f"PARTITION BY {part} " if part else ""
    grp = " GROUP BY 1" if part else ""
    return f""", n AS (SELECT *, product(1.0::DOUBLE + r) OVER ({over}ORDER BY trade_date) AS nav FROM r),
  p AS (SELECT *, greatest(1.0::DOUBLE, max(nav) OVER ({over}ORDER BY trade_date)) AS peak FROM n),
  a AS (SELECT {by}count(*) AS n_days, product(1.0::DOUBLE + r) AS total, avg(r) AS m, stddev_samp(r) AS s,
     least(0.0::DOUBLE, min(nav / peak - 1.0::DOUBLE)) AS mdd FROM p{grp}),
  q AS (SELECT *, pow(total, 252.0::DOUBLE / n_days) - 1.0::DOUBLE AS ar FROM a)
  SELECT {"year, " if part else ""}n_days, round(ar, 6) AS annual_return, round(m / s * sqrt(252.0::DOUBLE), 6) AS sharpe,
     round(mdd, 6) AS mdd, round(CASE WHEN mdd < 0 THEN ar / abs(mdd) END, 6) AS calmar FROM q"""


def _rounded(df, digits=6):
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


@query("a22_return_metrics", with_views("bars_d", RETURNS_SQL + _metrics_sql("")))
def _(spark, sf):
    return _rounded(series.return_metrics(daily_series(spark, sf), "r"))


@query("a23_yearly_metrics", with_views("bars_d", RETURNS_SQL + _metrics_sql("substr(trade_date, 1, 4)")))
def _(spark, sf):
    r = daily_series(spark, sf).withColumn("year", F.substring("trade_date", 1, 4))
    return _rounded(series.return_metrics(r, "r", ["year"]))


@query(
    "a24_group_totals",
    with_views(
        "bars_m",
        """& r AS (SELECT trade_date, 'G' || (CAST(vol AS BIGINT) % 4) AS group_id, avg(close / open - 1.0::DOUBLE) * 0.01::DOUBLE AS r
             FROM bars_m GROUP BY 1, 2)
        SELECT group_id, round(product(1.0::DOUBLE + r), 6) AS final_nav, round(product(1.0::DOUBLE + r) - 1.0::DOUBLE, 6) AS total_return
        FROM r GROUP BY 1""",
    ),
)
def _(spark, sf):
    names = [f"G{i}" for i in range(4)]
    g = F.concat(F.lit("G"), (F.col("vol").cast("long") % 4).cast("string"))
    ret = F.avg(F.col("close") / F.col("open") - 1.0) * 0.01
    wide = bars_m(spark, sf).withColumn("g", g).groupBy("trade_date").pivot("g", names).agg(ret)
    return _rounded(series.group_totals(wide, names))


@query(
    "a25_holding_period_return",
    with_views(
        "bars_d calendar",
        """& reb AS (SELECT max(cal_date) AS td FROM calendar WHERE is_open = '1' GROUP BY substr(cal_date, 1, 6)),
        seg AS (SELECT td, lead(td) OVER (ORDER BY td) AS nxt FROM reb),
        r AS (SELECT ts_code, trade_date, c / lag(c) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1.0::DOUBLE AS ret
              FROM (SELECT ts_code, trade_date, close * coalesce(adj_factor, 1.0) AS c FROM bars_d)),
        o AS (SELECT r.* FROM r JOIN calendar c ON c.cal_date = r.trade_date AND c.is_open = '1' WHERE ret IS NOT NULL)
        SELECT s.td AS trade_date, o.ts_code, round(product(1.0::DOUBLE + o.ret) - 1.0::DOUBLE, 5) AS period_return
        FROM o JOIN seg s ON o.trade_date > s.td AND o.trade_date <= s.nxt GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    from barloom.plans import backtest

    cal = calendar(spark, sf)
    opens = spine.open_dates(cal)
    days = backtest.holding_days(spine.last_of_period(opens, "monthly").select("trade_date"), opens)
    rets = backtest.daily_returns(bars_d(spark, sf))
    return _rounded(backtest.period_returns(rets, days).select("trade_date", "ts_code", "period_return"), 5)


@query(
    "a27_average_turnover",
    with_views(
        "bars_m",
        "&" + GROUPS_SQL[1:] + "SELECT rebalance_no, round(sum(abs(dw)) / 5, 8) AS turnover FROM t GROUP BY 1",
    ),
)
def _(spark, sf):
    by_group = portfolio.turnover_by_group(portfolio.holdings_delta(holdings(spark, sf)))
    return portfolio.average_turnover(by_group, 5).select("rebalance_no", F.round("turnover", 8).alias("turnover"))


@query(
    "a28_quality_warnings",
    with_views(
        "bars_m",
        """& r AS (SELECT ts_code, trade_date, c / lag(c) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1.0::DOUBLE AS ret
              FROM (SELECT ts_code, trade_date, close * coalesce(adj_factor, 1.0) AS c FROM bars_m)),
        o AS (SELECT trade_date, ret, row_number() OVER (PARTITION BY trade_date ORDER BY ret, ts_code) - 1 AS i,
                     count(*) OVER (PARTITION BY trade_date) AS n FROM r WHERE ret IS NOT NULL),
        m AS (SELECT trade_date, ret FROM o WHERE i = n // 2),
        s AS (SELECT count(*) AS n, count(*) FILTER (adj_factor IS NULL) AS nulls FROM bars_m)
        SELECT 'few_rebalances' AS warning, 2.0::DOUBLE AS value, CAST(NULL AS VARCHAR) AS trade_date
        UNION ALL SELECT 'median_return', round(ret, 6), trade_date FROM m
            WHERE trade_date = (SELECT min(trade_date) FROM m WHERE abs(ret) > 0.20)
        UNION ALL SELECT 'adj_factor_nulls', round(nulls::DOUBLE / n, 6), NULL FROM s WHERE nulls::DOUBLE / n > 0.05""",
    ),
)
def _(spark, sf):
    from barloom.plans import backtest

    b = bars_m(spark, sf)
    w = backtest.quality_warnings(b, backtest.daily_returns(b), n_rebalances=2, n_days=83)
    return w.withColumn("value", F.round("value", 6))


# ── registry report ──────────────────────────────────────────────────────


def missing_log(spark, sf):
    """Registry rows from lineitem: every returned line is a missed key, its quantity the number of tries."""
    from barloom.catalog.views import code

    li = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    g = li.groupBy("l_suppkey", F.to_date("l_shipdate").alias("d")).agg(F.max("l_quantity").alias("q"))
    return g.select(
        code(F.col("l_suppkey")).alias("ts_code"),
        F.lit("kline_daily").alias("missing_entity"),
        ymd(F.col("d")).alias("missing_date"),
        (F.col("q") % 14).cast("int").alias("try_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_try_time"),
    )


LOG_SQL = f"""log AS MATERIALIZED (SELECT {code_sql('l_suppkey')} AS ts_code, 'kline_daily' AS missing_entity, strftime(d, '%Y%m%d') AS missing_date,
    CAST(q % 14 AS INTEGER) AS try_count, CAST(NULL AS TIMESTAMP) AS last_try_time
  FROM (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS d, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2))"""

BOARD_SQL = """CASE WHEN right(ts_code, 3) = '.BJ' THEN '北交所(BJ)'
  WHEN right(ts_code, 3) = '.SH' THEN CASE WHEN ts_code LIKE '688%' THEN '科创板(688)'
     WHEN substr(ts_code, 1, 3) IN ('600', '601', '603', '605') THEN '沪主板(60x)' WHEN ts_code LIKE '900%' THEN '沪B股(900)'
     ELSE '沪其他(' || substr(ts_code, 1, 3) || ')' END
  WHEN right(ts_code, 3) = '.SZ' THEN CASE WHEN substr(ts_code, 1, 3) IN ('300', '301') THEN '创业板(300/301)'
     WHEN substr(ts_code, 1, 3) IN ('000', '001') THEN '深主板(000/001)' WHEN substr(ts_code, 1, 3) IN ('002', '003') THEN '中小板(002/003)'
     WHEN ts_code LIKE '200%' THEN '深B股(200)' ELSE '深其他(' || substr(ts_code, 1, 3) || ')' END END"""


def _share_sql(label: str, name: str) -> str:
    return f"""WITH {LOG_SQL} SELECT {label} AS {name}, count(*) AS n_missing,
      round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM log) * 100, 2) AS share_pct FROM log GROUP BY 1"""


@query("a29_missing_by_board", _share_sql(BOARD_SQL, "board"))
def _(spark, sf):
    from barloom.functions.scalars import board

    return registry.count_by(missing_log(spark, sf), board(F.col("ts_code")), "board")


@query("a29b_missing_by_year", _share_sql("substr(missing_date, 1, 4)", "year"))
def _(spark, sf):
    return registry.count_by(missing_log(spark, sf), registry.year(F.col("missing_date")), "year")


@query(
    "a29c_missing_board_by_year",
    f"""WITH {LOG_SQL}, b AS (SELECT substr(missing_date, 1, 4) AS year, {BOARD_SQL} AS board FROM log)
    SELECT year, count(*) FILTER (board = '沪主板(60x)') AS "沪主板(60x)", count(*) FILTER (board = '深主板(000/001)') AS "深主板(000/001)",
      count(*) FILTER (board = '北交所(BJ)') AS "北交所(BJ)", count(*) FILTER (board = '沪B股(900)') AS "沪B股(900)" FROM b GROUP BY 1""",
)
def _(spark, sf):
    return registry.by_board_and_year(missing_log(spark, sf), ["沪主板(60x)", "深主板(000/001)", "北交所(BJ)", "沪B股(900)"])


@query(
    "a29d_missing_by_retries",
    _share_sql("CASE WHEN try_count <= 1 THEN '1 次' WHEN try_count <= 3 THEN '2-3 次' WHEN try_count <= 10 THEN '4-10 次' ELSE '>10 次' END", "bucket"),
)
def _(spark, sf):
    return registry.count_by(missing_log(spark, sf), registry.retry_bucket(F.col("try_count")), "bucket")


@query(
    "a29e_worst_codes",
    with_views(
        "listing",
        f"""& {LOG_SQL}, t AS (SELECT ts_code, count(*) AS n_missing, max(try_count) AS max_tries FROM log GROUP BY 1
             ORDER BY 2 DESC, 1 LIMIT 30)
        SELECT t.*, name, list_date, delist_date FROM t LEFT JOIN listing USING (ts_code)""",
    ),
)
def _(spark, sf):
    return registry.worst_codes(missing_log(spark, sf), listing(spark, sf))


@query(
    "a29f_missing_by_status",
    with_views(
        "listing",
        f"""& {LOG_SQL}, c AS (SELECT ts_code, count(*) AS n FROM log GROUP BY 1),
        s AS (SELECT ts_code, CASE WHEN coalesce(delist_date, '') <> '' THEN 'D' WHEN is_ggt = 1 THEN 'L' ELSE 'X' END AS st
              FROM listing WHERE market = '主板')
        SELECT CASE WHEN s.ts_code IS NULL THEN '未在 stock_list' WHEN st = 'L' THEN '在市(L)' WHEN st = 'D' THEN '退市(D)'
                    WHEN st = 'P' THEN '暂停上市(P)' ELSE '其他(' || st || ')' END AS status,
               CAST(sum(n) AS BIGINT) AS n_missing, count(*) AS n_codes
        FROM c LEFT JOIN s USING (ts_code) GROUP BY 1""",
    ),
)
def _(spark, sf):
    st = F.when(F.coalesce(F.col("delist_date"), F.lit("")) != "", F.lit("D")).when(F.col("is_ggt") == 1, F.lit("L")).otherwise(F.lit("X"))
    known = listing(spark, sf).where(F.col("market") == "主板").select("ts_code", st.alias("list_status"))
    return registry.by_listing_status(missing_log(spark, sf), known)
