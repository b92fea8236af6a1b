"""A31-A38, L3, C16: completeness dashboards over snapshots that the given tables yield."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom.catalog.aggregates import _OPEN_KEYS, _PERIODS_SQL, STATEMENTS, _active_sql, active, due_periods, open_keys, statements
from barloom.catalog.joins import LISTED_SQL
from barloom.catalog.registry import query
from barloom.catalog.views import (
    REPORT_TYPES,
    SOURCE_CLASSES,
    bars_d,
    calendar,
    companies,
    market,
    report_quarters,
    source_class,
    table,
    with_views,
    ymd,
)
from barloom.operators import completeness, spine, universe
from barloom.plans import dashboards as D

# Every line is a row of one of its group's sources, by its class.
_DAILY = {
    "market_trade_date": [c.key for c in D.GROUPS["market_trade_date"].columns],
    "financial_ann_date": [c.key for c in D.GROUPS["financial_ann_date"].columns],
    "kline_trade_date": ["kline_stock_factor"],
    "index_trade_date": ["index_daily"],
    "stock_basic_trade_date": ["stock_premarket", "stock_share_float"],
    "index_month": ["index_weight"],
}


def _dealt(days, names: list[str]):
    """(d, source_name, resolved_count) of rows (d, s0...) that count a day's lines by class."""
    classes = F.array(*[F.struct(F.lit(names[i % len(names)]).alias("source_name"), F.col(f"s{i}").alias("n")) for i in range(SOURCE_CLASSES)])
    rows = days.select("d", F.explode(classes).alias("c")).select("d", "c.*").where("n > 0")
    return rows.groupBy("d", "source_name").agg(F.sum("n").alias("resolved_count"))


def snapshots_d(spark, sf, group: str, m=None):
    """Daily snapshots of a group's sources, from the lines or from the days of a `Market`."""
    if m is None:
        by = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d"))
        per_day = by.agg(*[F.count_if(source_class() == i).alias(f"s{i}") for i in range(SOURCE_CLASSES)])
    else:
        per_day = m.days.groupBy("d").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(SOURCE_CLASSES)])
    return _dealt(per_day, _DAILY[group]).select(
        "source_name", ymd(F.col("d")).alias("date_key"), F.lit(3).cast("bigint").alias("period_stock_count"), "resolved_count"
    )


def snapshots_d_sql(group: str) -> str:
    names = _DAILY[group]
    return f"""snaps AS (SELECT ({names})[(l_orderkey + l_linenumber) % {SOURCE_CLASSES} % {len(names)} + 1] AS source_name,
      strftime(CAST(l_shipdate AS DATE), '%Y%m%d') AS date_key, CAST(3 AS BIGINT) AS period_stock_count, count(*) AS resolved_count FROM lineitem GROUP BY 1, 2)"""


_PERIOD_SOURCES = ["financial_forecast", "financial_express", "financial_audit", "financial_disclosure_date", "financial_fina_mainbz"]


def cells_sql(group: str, own: bool, counted: str | None) -> str:
    """Cells over the views spine(date_key[, period_stock_count]), snaps, and cnt(date_key, one column per counted source)."""
    g = D.GROUPS[group]
    cols = ", ".join(f"({i}, '{c.key}', {c.threshold}::DOUBLE, {str(c.counted).lower()}, {str(c.pulled_only).lower()})" for i, c in enumerate(g.columns))
    live = ""
    if counted:
        live = "".join(f" UNION ALL SELECT '{c.key}', date_key, {c.key}, CAST(NULL AS BIGINT) FROM cnt" for c in g.columns if c.counted)
    psc = "coalesce(k.p, 0)" if own else "s.period_stock_count"
    return f""", cfg(column_no, column_key, threshold, counted, pulled_only) AS (VALUES {cols}),
  known AS (SELECT source_name AS column_key, date_key, resolved_count AS n, period_stock_count AS p FROM snaps
     WHERE source_name IN (SELECT column_key FROM cfg WHERE NOT counted AND NOT pulled_only){live}),
  raw AS (SELECT '{group}' AS group_id, s.date_key, c.column_no, c.column_key, c.threshold, CAST(coalesce(k.n, 0) AS BIGINT) AS count,
     CAST({psc} AS BIGINT) AS period_stock_count, (c.counted OR k.n IS NOT NULL) AS has_snapshot
     FROM spine s CROSS JOIN cfg c LEFT JOIN known k ON k.date_key = s.date_key AND k.column_key = c.column_key),
  cells AS (SELECT *, CASE WHEN NOT has_snapshot THEN NULL WHEN threshold <= 0 THEN CASE WHEN period_stock_count > 0 THEN 1.0::DOUBLE END
        WHEN period_stock_count > 0 THEN count::DOUBLE / period_stock_count END AS ratio,
     has_snapshot AND (threshold <= 0 OR (period_stock_count > 0 AND count::DOUBLE / nullif(period_stock_count, 0) >= threshold)) AS is_complete FROM raw)
"""


_CELL_OUT = "SELECT group_id, date_key, column_key, count, period_stock_count, round(ratio, 6) AS ratio, is_complete, has_snapshot FROM cells"


def _out(cells):
    return cells.select(
        "group_id", "date_key", "column_key", "count", "period_stock_count", F.round("ratio", 6).alias("ratio"), "is_complete", "has_snapshot"
    )


# ── one group each ───────────────────────────────────────────────────────

PERIOD_SQL = f"""& pk AS ({_PERIODS_SQL}),
  spine AS (SELECT p.date_key, count(l.ts_code) AS period_stock_count FROM pk p LEFT JOIN companies l ON {LISTED_SQL.format(l='l', d='p.date_key')} GROUP BY 1),
  cnt AS (SELECT date_key, coalesce(report_income, 0) AS report_income, coalesce(report_balance, 0) AS report_balance,
       coalesce(report_cashflow, 0) AS report_cashflow, coalesce(report_indicator, 0) AS report_indicator FROM pk LEFT JOIN
     (SELECT end_date AS date_key, count(*) FILTER (report_type = '1') AS report_income, count(*) FILTER (report_type = '2') AS report_balance,
       count(*) FILTER (report_type = '3') AS report_cashflow, count(*) FILTER (report_type = '4') AS report_indicator FROM reports GROUP BY 1) USING (date_key)),
  snaps AS (SELECT ({_PERIOD_SOURCES})[CAST(report_type AS INTEGER)] AS source_name, end_date AS date_key, CAST(500 AS BIGINT) AS period_stock_count,
     count(*) AS resolved_count FROM reports WHERE update_flag = '1' AND end_date > '1997' GROUP BY 1, 2)
"""


def period_cells(spark, sf):
    q = report_quarters(spark, sf)
    keys = due_periods(spark, sf).select(F.col("end_date").alias("date_key"))
    sp = universe.listed_counts(companies(spark, sf, q), keys).withColumnRenamed("listed_count", "period_stock_count")
    counts = completeness.period_counts(q, statements()).select(F.col("end_date").alias("date_key"), *[F.col(f"{n}_count").alias(f"report_{n}") for n in STATEMENTS])
    updated = q.where("end_date > '1997'").groupBy("end_date").agg(*[F.sum(f"u{t}").alias(f"u{t}") for t in REPORT_TYPES])
    each = F.array(*[F.struct(F.lit(n).alias("source_name"), F.col(f"u{t}").alias("n")) for n, t in zip(_PERIOD_SOURCES, REPORT_TYPES)])
    snaps = updated.select("end_date", F.explode(each).alias("s")).where("s.n > 0").select(
        "s.source_name", F.col("end_date").alias("date_key"), F.lit(500).cast("bigint").alias("period_stock_count"), F.col("s.n").alias("resolved_count")
    )
    return D.cells(D.GROUPS["financial_report_period"], sp, snaps, counts)


@query("a33_grid_periods", with_views("reports companies", PERIOD_SQL + cells_sql("financial_report_period", False, "cnt") + _CELL_OUT))
def _(spark, sf):
    return _out(period_cells(spark, sf))


_ALL_DAYS_KEYS = "keys AS (SELECT cal_date AS date_key FROM calendar WHERE is_open = '1')"
ANN_SQL = (
    "& " + _ALL_DAYS_KEYS + _active_sql("keys")
    + f""", {snapshots_d_sql('financial_ann_date')},
  spine AS (SELECT c.cal_date AS date_key, coalesce(a.listed_count, 0) AS period_stock_count FROM (SELECT cal_date FROM calendar WHERE cal_date >= '19960101') c
     ASOF LEFT JOIN act a ON c.cal_date >= a.date_key)
"""
)


def ann_cells(spark, sf):
    m = market(spark, sf, sources=True)
    days = m.calendar.where("cal_date >= '19960101'").select(F.col("cal_date").alias("date_key"))
    sp = universe.denominators(days, "date_key", active(m, open_keys(m)), spine.open_dates(m.calendar), "listed_count")
    return D.cells(D.GROUPS["financial_ann_date"], sp.withColumnRenamed("expected", "period_stock_count"), snapshots_d(spark, sf, "financial_ann_date", m))


@query("a33b_grid_ann_dates", with_views("listing suspend calendar", ANN_SQL + cells_sql("financial_ann_date", False, None) + _CELL_OUT))
def _(spark, sf):
    return _out(ann_cells(spark, sf))


def _open_spine_sql() -> str:
    return "& " + _OPEN_KEYS + _active_sql("keys") + ", spine AS (SELECT date_key, trading_count AS period_stock_count FROM act)\n"


def open_spine(m):
    return active(m, open_keys(m)).select("date_key", F.col("trading_count").alias("period_stock_count"))


BARS_SQL = _open_spine_sql() + f""", {snapshots_d_sql('kline_trade_date')},
  cnt AS (SELECT date_key, coalesce(n, 0) AS kline_daily, coalesce(a, 0) AS kline_adj_factor, coalesce(u, 0) AS kline_stk_limit FROM keys LEFT JOIN
     (SELECT trade_date AS date_key, count(*) AS n, count(adj_factor) AS a, count(up_limit) AS u FROM bars_d GROUP BY 1) USING (date_key))
"""


def bar_cells(m):
    b = completeness.bar_counts(m.bars).select(
        F.col("trade_date").alias("date_key"),
        F.col("kline_daily_count").alias("kline_daily"),
        F.col("kline_adj_factor_count").alias("kline_adj_factor"),
        F.col("kline_stk_limit_count").alias("kline_stk_limit"),
    )
    return D.cells(D.GROUPS["kline_trade_date"], open_spine(m), snapshots_d(None, None, "kline_trade_date", m), b)


@query("a33c_grid_bars", with_views("listing suspend calendar bars_d", BARS_SQL + cells_sql("kline_trade_date", False, "cnt") + _CELL_OUT))
def _(spark, sf):
    return _out(bar_cells(market(spark, sf, bars=True, sources=True)))


_KEY_SPINE = "spine AS (SELECT cal_date AS date_key FROM calendar WHERE is_open = '1')"
MARKET_SQL = f"& {_KEY_SPINE}, {snapshots_d_sql('market_trade_date')}\n"


def market_cells(m):
    return D.cells(D.GROUPS["market_trade_date"], open_keys(m), snapshots_d(None, None, "market_trade_date", m))


@query("a33d_grid_market", with_views("calendar", MARKET_SQL + cells_sql("market_trade_date", True, None) + _CELL_OUT))
def _(spark, sf):
    return _out(market_cells(market(spark, sf, sources=True)))


BASIC_SQL = _open_spine_sql() + f""", {snapshots_d_sql('stock_basic_trade_date')},
  cnt AS (SELECT date_key, coalesce(n, 0) AS stock_suspend FROM keys LEFT JOIN
     (SELECT trade_date AS date_key, count(*) AS n FROM suspend GROUP BY 1) USING (date_key))
"""


def basic_cells(m):
    n = m.suspend.groupBy(F.col("trade_date").alias("date_key")).agg(F.count(F.lit(1)).alias("stock_suspend"))
    return D.cells(D.GROUPS["stock_basic_trade_date"], open_spine(m), snapshots_d(None, None, "stock_basic_trade_date", m), n)


@query("a33e_grid_basic", with_views("listing suspend calendar", BASIC_SQL + cells_sql("stock_basic_trade_date", False, "cnt") + _CELL_OUT))
def _(spark, sf):
    return _out(basic_cells(market(spark, sf, sources=True)))


@query(
    "a33f_grid_index_days",
    with_views("calendar", f"& {_KEY_SPINE}, {snapshots_d_sql('index_trade_date')}\n" + cells_sql("index_trade_date", True, None) + _CELL_OUT),
)
def _(spark, sf):
    m = market(spark, sf, sources=True)
    return _out(D.cells(D.GROUPS["index_trade_date"], open_keys(m), snapshots_d(spark, sf, "index_trade_date", m)))


@query(
    "a34_grid_months",
    with_views(
        "calendar",
        f"""& spine AS (SELECT DISTINCT substr(cal_date, 1, 6) AS date_key FROM calendar), {snapshots_d_sql('index_month').replace('snaps AS', 'sd AS')},
        snaps AS (SELECT source_name, substr(date_key, 1, 6) AS date_key, max(period_stock_count) AS period_stock_count, max(resolved_count) AS resolved_count
           FROM sd GROUP BY 1, 2)
        """
        + cells_sql("index_month", True, None)
        + _CELL_OUT,
    ),
)
def _(spark, sf):
    m = market(spark, sf, sources=True)
    months = m.calendar.select(F.substring("cal_date", 1, 6).alias("date_key")).distinct()
    best = D.best_of_month(snapshots_d(spark, sf, "index_month", m))
    return _out(D.cells(D.GROUPS["index_month"], months, best))


# ── cells, rows, gaps, health ────────────────────────────────────────────


@query(
    "a31_cell_metric",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
      CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 7 THEN CASE WHEN l_suppkey % 40 > 0 THEN 1.0::DOUBLE END
           WHEN l_suppkey % 40 > 0 THEN round(l_quantity / (l_suppkey % 40), 6) END AS ratio,
      CASE WHEN l_linenumber = 6 THEN false WHEN l_linenumber = 7 THEN true
           ELSE l_suppkey % 40 > 0 AND coalesce(l_quantity / nullif(l_suppkey % 40, 0) >= 0.95, false) END AS is_complete FROM lineitem""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    m = completeness.metric(
        F.col("l_quantity"), F.col("l_suppkey") % 40, F.when(F.col("l_linenumber") == 7, F.lit(0.0)).otherwise(F.lit(0.95)), F.col("l_linenumber") != 6
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        F.round(m["ratio"], 6).alias("ratio"), m["is_complete"].alias("is_complete"),
    )


@query(
    "a32_row_completeness",
    with_views(
        "calendar",
        MARKET_SQL + cells_sql("market_trade_date", True, None)
        + """SELECT date_key, round(max(ratio) FILTER (column_key = 'market_moneyflow'), 6) AS market_moneyflow,
          coalesce(bool_and(is_complete) FILTER (has_snapshot), false) AS row_complete FROM cells GROUP BY 1""",
    ),
)
def _(spark, sf):
    r = D.rows(market_cells(market(spark, sf, sources=True)), D.GROUPS["market_trade_date"])
    return r.select("date_key", F.round("market_moneyflow", 6).alias("market_moneyflow"), "row_complete")


@query(
    "a32b_dashboard_page",
    with_views(
        "calendar",
        MARKET_SQL + cells_sql("market_trade_date", True, None)
        + """SELECT date_key, coalesce(bool_and(is_complete) FILTER (has_snapshot), false) AS row_complete FROM cells
        WHERE date_key IN (SELECT date_key FROM spine ORDER BY 1 DESC LIMIT 20 OFFSET 40) GROUP BY 1""",
    ),
)
def _(spark, sf):
    m, g = market(spark, sf, sources=True), D.GROUPS["market_trade_date"]
    page = spine.page_of(open_keys(m), "date_key", 3, 20)
    return D.rows(D.cells(g, page, snapshots_d(spark, sf, "market_trade_date", m)), g).select("date_key", "row_complete")


_SUMMARY = """, rws AS (SELECT group_id, date_key, coalesce(bool_and(is_complete) FILTER (has_snapshot), false) AS ok FROM cells GROUP BY 1, 2),
  rs AS (SELECT group_id, count(*) AS window_row_count, count(*) FILTER (ok) AS rows_complete FROM rws GROUP BY 1),
  cs AS (SELECT group_id, count(*) FILTER (threshold > 0) AS n, count(*) FILTER (threshold > 0 AND is_complete) AS k,
     max(date_key) FILTER (threshold > 0 AND NOT is_complete) AS latest_gap_date_key, min(ratio) FILTER (threshold > 0) AS worst_ratio FROM cells GROUP BY 1),
  wc AS (SELECT c.group_id, min(column_key) AS worst_column FROM cells c JOIN cs ON c.group_id = cs.group_id AND c.ratio = cs.worst_ratio AND c.threshold > 0 GROUP BY 1)
  SELECT rs.group_id, window_row_count, rows_complete, round(CASE WHEN n > 0 THEN k::DOUBLE / n ELSE 1.0::DOUBLE END, 4) AS complete_rate,
    n - k AS gap_cell_count, CASE WHEN n > 0 AND n = k THEN 'healthy' WHEN n = 0 OR k::DOUBLE / n >= 0.8 THEN 'warning' ELSE 'critical' END AS status,
    worst_column, round(worst_ratio, 6) AS worst_ratio, latest_gap_date_key
  FROM rs JOIN cs USING (group_id) LEFT JOIN wc USING (group_id)"""


def _rounded_summary(df):
    return df.withColumn("worst_ratio", F.round("worst_ratio", 6))


@query("a35_group_health", with_views("calendar", MARKET_SQL + cells_sql("market_trade_date", True, None) + _SUMMARY))
def _(spark, sf):
    return _rounded_summary(completeness.group_summary(market_cells(market(spark, sf, sources=True))))


@query(
    "a36_freshness",
    with_views(
        "bars_d calendar",
        """& b AS (SELECT ts_code, max(trade_date) AS latest FROM bars_d GROUP BY 1), r AS (SELECT max(cal_date) AS ref FROM calendar WHERE is_open = '1')
        SELECT ts_code, latest, CAST(date_diff('day', strptime(latest, '%Y%m%d'), strptime(ref, '%Y%m%d')) AS INTEGER) AS lag_days,
          CASE WHEN date_diff('day', strptime(latest, '%Y%m%d'), strptime(ref, '%Y%m%d')) <= 1 THEN 'ok'
               WHEN date_diff('day', strptime(latest, '%Y%m%d'), strptime(ref, '%Y%m%d')) <= 3 THEN 'warning' ELSE 'critical' END AS status FROM b, r""",
    ),
)
def _(spark, sf):
    ref = spine.open_dates(calendar(spark, sf)).agg(F.max("trade_date")).scalar()
    latest = bars_d(spark, sf).groupBy("ts_code").agg(F.max("trade_date").alias("latest")).withColumn("_ref", ref)
    return latest.withColumns(completeness.freshness(F.col("latest"), F.col("_ref"))).drop("_ref")


@query(
    "a38_distinct_keys",
    f"WITH {snapshots_d_sql('market_trade_date')} SELECT count(DISTINCT date_key) AS n_keys FROM snaps WHERE source_name IN ('market_moneyflow', 'market_hk_hold') AND date_key BETWEEN '19960101' AND '19991231'",
)
def _(spark, sf):
    s = snapshots_d(spark, sf, "market_trade_date").where(
        F.col("source_name").isin("market_moneyflow", "market_hk_hold") & F.col("date_key").between("19960101", "19991231")
    )
    return s.select("date_key").distinct().agg(F.count(F.lit(1)).alias("n_keys"))


@query(
    "l3_top_gaps",
    with_views(
        "calendar",
        MARKET_SQL + cells_sql("market_trade_date", True, None)
        + """SELECT date_key, column_key, round(ratio, 6) AS ratio FROM cells WHERE threshold > 0 AND NOT is_complete
        ORDER BY date_key DESC, group_id, column_key LIMIT 20""",
    ),
)
def _(spark, sf):
    return D.gaps(market_cells(market(spark, sf, sources=True)), 20).select("date_key", "column_key", F.round("ratio", 6).alias("ratio"))


def _named(sql: str, group: str, own: bool, counted, suffix: str) -> str:
    """The views of one group under their own names, so that several groups fit in one statement."""
    text = sql[1:].strip() + cells_sql(group, own, counted)
    for v in ("spine", "snaps", "cnt", "cfg", "known", "raw", "cells", "keys", "act_l", "act_s", "act", "pk"):
        text = re.sub(rf"\b{v}\b(?!\.)", f"{v}_{suffix}", text)
    return text


@query(
    "c16_overview",
    with_views(
        "listing suspend calendar bars_d reports companies",
        "& "
        + ", ".join(
            [
                _named(PERIOD_SQL, "financial_report_period", False, "cnt", "p"),
                _named(BARS_SQL, "kline_trade_date", False, "cnt", "b"),
                _named(MARKET_SQL, "market_trade_date", True, None, "m"),
                _named(BASIC_SQL, "stock_basic_trade_date", False, "cnt", "s"),
            ]
        )
        + ", cells AS (SELECT * FROM cells_p UNION ALL BY NAME SELECT * FROM cells_b UNION ALL BY NAME SELECT * FROM cells_m UNION ALL BY NAME SELECT * FROM cells_s)"
        + _SUMMARY,
    ),
)
def _(spark, sf):
    m = market(spark, sf, bars=True, sources=True)
    groups = [period_cells(spark, sf), bar_cells(m), market_cells(m), basic_cells(m)]
    return _rounded_summary(D.overview(groups))
