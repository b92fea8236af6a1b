"""F: row-wise functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.aggregates import BOARD_SQL
from barloom.catalog.joins import GROUPS_SQL, holdings
from barloom.catalog.registry import query
from barloom.catalog.rolling import _P, panel
from barloom.catalog.views import bars_d, bars_m, landing, listing, table, with_views
from barloom.functions import scalars, text
from barloom.operators import portfolio


@query(
    "f1_abs_log_sign",
    with_views(
        "bars_m",
        _P
        + """SELECT ts_code, trade_date, abs(x - 3000) AS a, round(CASE WHEN y > 100 THEN ln(y - 100) END, 8) AS l,
        CASE WHEN x > 3000 THEN 1.0::DOUBLE WHEN x < 3000 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM p""",
    ),
)
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    return panel(spark, sf).select(
        "ts_code",
        "trade_date",
        F.abs(x - 3000).alias("a"),
        F.round(scalars.log(y - 100), 8).alias("l"),
        scalars.sign(x - 3000).alias("s"),
    )


@query(
    "f2_max_min",
    with_views("bars_m", _P + "SELECT ts_code, trade_date, greatest(x, open) AS hi, least(x, open) AS lo FROM p"),
)
def _(spark, sf):
    return panel(spark, sf).select(
        "ts_code", "trade_date", F.greatest("x", "open").alias("hi"), F.least("x", "open").alias("lo")
    )


@query(
    "f3_where",
    with_views("bars_m", _P + "SELECT ts_code, trade_date, CASE WHEN x > 3000 THEN y ELSE -y END AS value FROM p"),
)
def _(spark, sf):
    v = scalars.where(F.col("x") > 3000, F.col("y"), -F.col("y"))
    return panel(spark, sf).select("ts_code", "trade_date", v.alias("value"))


@query(
    "f4_and_or",
    with_views(
        "bars_m",
        """SELECT ts_code, trade_date, CASE WHEN CAST(vol AS BIGINT) % 2 <> 0 AND CAST(vol AS BIGINT) % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS both,
        CASE WHEN CAST(vol AS BIGINT) % 2 <> 0 OR CAST(vol AS BIGINT) % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS either FROM bars_m""",
    ),
)
def _(spark, sf):
    a, b = F.col("vol") % 2, F.col("vol") % 3
    return bars_m(spark, sf).select(
        "ts_code", "trade_date", scalars.both(a, b).alias("both"), scalars.either(a, b).alias("either")
    )


@query("f5_filter", with_views("bars_m", _P + "SELECT ts_code, trade_date, CASE WHEN x > 3000 THEN y END AS value FROM p"))
def _(spark, sf):
    return panel(spark, sf).select("ts_code", "trade_date", scalars.keep_if(F.col("y"), F.col("x") > 3000).alias("value"))


@query(
    "f7_vwap",
    with_views("bars_d", "SELECT ts_code, trade_date, CASE WHEN vol > 20 THEN amount * 10.0::DOUBLE / (vol - 20) END AS vwap FROM bars_d"),
)
def _(spark, sf):
    return bars_d(spark, sf).select("ts_code", "trade_date", scalars.vwap(F.col("amount"), F.col("vol") - 20).alias("vwap"))


DIRECTIONAL_SQL = """, lagged AS (SELECT *, lag(o) OVER w AS o1, lag(h) OVER w AS h1, lag(l) OVER w AS l1, lag(c) OVER w AS c1
   FROM adj WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)),
 dir AS (SELECT ts_code, trade_date,
   CASE WHEN o <= o1 THEN 0.0::DOUBLE ELSE greatest(h - o, o - o1) END AS dtm,
   CASE WHEN o >= o1 THEN 0.0::DOUBLE ELSE greatest(o - l, o - o1) END AS dbm,
   CASE WHEN h1 - h > 0 THEN h1 - h ELSE 0.0::DOUBLE END AS hd, CASE WHEN l1 - l > 0 THEN l1 - l ELSE 0.0::DOUBLE END AS ld,
   greatest(h - l, abs(h - c1), abs(l - c1)) AS tr FROM lagged)
"""
ADJ_SQL = """& adj AS (SELECT ts_code, trade_date, open * coalesce(adj_factor, 1.0) AS o, high * coalesce(adj_factor, 1.0) AS h,
   low * coalesce(adj_factor, 1.0) AS l, close * coalesce(adj_factor, 1.0) AS c, vol, amount FROM bars_m)
"""


@query("f8_directional", with_views("bars_m", ADJ_SQL + DIRECTIONAL_SQL + "SELECT * FROM dir"))
def _(spark, sf):
    cols = [scalars.adjusted(F.col(c), F.col("adj_factor")).alias(c) for c in ("open", "high", "low", "close")]
    adj = bars_m(spark, sf).select("ts_code", "trade_date", *cols)
    d = scalars.directional(*[F.col(c) for c in ("open", "high", "low", "close")])
    return adj.select("ts_code", "trade_date", *[c.alias(n) for n, c in d.items()])


@query(
    "f9_date_key",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE strftime(ts, '%Y%m%d') END AS k FROM events""",
)
def _(spark, sf):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("2024-1")).when(F.col("event_id") % 5 != 0, F.date_format("ts", " yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", text.date_key(raw).alias("k"))


@query(
    "f10_date_digits",
    "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y%m%d') END AS k FROM events",
)
def _(spark, sf):
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("2024/1")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm"))
    return table(spark, sf, "events").select("event_id", text.date_digits(raw).alias("k"))


@query(
    "f11_blank_text",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_type = 'view' THEN '' ELSE event_type END AS v FROM events""",
)
def _(spark, sf):
    e = F.col("event_type")
    raw = F.when(e == "view", F.lit(" NaN ")).when(F.col("event_id") % 4 != 0, F.concat(F.lit("  "), e, F.lit(" ")))
    raw = F.when((F.col("event_id") % 4 == 0) & (F.col("event_id") % 8 == 0), F.lit("None")).otherwise(raw)
    return table(spark, sf, "events").select("event_id", text.blank_text(raw).alias("v"))


@query(
    "f12_number",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events",
)
def _(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", text.number(raw).alias("v"))


@query("f13_unit", "SELECT event_id, value * 10.0::DOUBLE AS amount FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", text.ten_thousand_to_thousand(F.col("value")).alias("amount"))


@query(
    "f14_time_key",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y%m%d') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y%m%d%H%M%S')
       ELSE strftime(ts, '%Y%m') END AS k FROM events""",
)
def _(spark, sf):
    m = F.col("event_id") % 3
    raw = (
        F.when(m == 0, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(m == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"))
        .otherwise(F.date_format("ts", "yyyy-MM"))
    )
    return table(spark, sf, "events").select("event_id", text.time_key(raw).alias("k"))


@query(
    "f14b_time_range",
    with_views(
        "landing",
        """SELECT ordinal, substr(trade_time, 1, 12) AS trade_time FROM landing
        WHERE substr(trade_time, 1, 12) >= '202401050000' AND substr(trade_time, 1, 12) <= '202401101530'""",
    ),
)
def _(spark, sf):
    la = landing(spark, sf).select("ordinal", F.substring("trade_time", 1, 12).alias("trade_time"))
    return la.where(text.in_range(F.col("trade_time"), "2024-01-05", "2024-01-10 15:30", minute=True))


@query(
    "f14c_day_range",
    with_views("landing", "SELECT ordinal, trade_date FROM landing WHERE trade_date BETWEEN '20240105' AND '20240110'"),
)
def _(spark, sf):
    la = landing(spark, sf).select("ordinal", "trade_date")
    return la.where(text.in_range(F.col("trade_date"), "2024-01-05", "2024-01-10 15:30", minute=False))


@query("f15_b_share", with_views("listing", "SELECT ts_code, (ts_code LIKE '9009%' OR ts_code LIKE '200%') AS is_b FROM listing"))
def _(spark, sf):
    return listing(spark, sf).select("ts_code", scalars.is_b_share(F.col("ts_code")).alias("is_b"))


@query("f16_board", with_views("listing", f"SELECT ts_code, {BOARD_SQL} AS board FROM listing"))
def _(spark, sf):
    return listing(spark, sf).select("ts_code", scalars.board(F.col("ts_code")).alias("board"))


@query("f17_delisted_name", with_views("listing", "SELECT ts_code, contains(name, '(退)') AS gone FROM listing"))
def _(spark, sf):
    return listing(spark, sf).select("ts_code", scalars.delisted_name(F.col("name"), F.col("fullname")).alias("gone"))


_FIELDS = ["turnover_rate", "pe_ttm", "downdays", "topdays", "macd", "total_mv"]


@query(
    "f18_factor_category",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN '统计' WHEN 3 THEN '统计' WHEN 4 THEN '技术' ELSE '基本面' END AS category FROM part""",
)
def _(spark, sf):
    name = F.element_at(F.array(*[F.lit(f) for f in _FIELDS]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", scalars.factor_category(name).alias("category"))


@query(
    "f19_vendor_names",
    with_views("bars_m", "SELECT ts_code, trade_date, open, high AS down_streak, low AS ma_5, close AS high_period FROM bars_m"),
)
def _(spark, sf):
    raw = bars_m(spark, sf).select(
        "ts_code",
        "trade_date",
        F.col("open").alias("open_hfq"),
        F.col("high").alias("downdays"),
        F.col("low").alias("ma_hfq_5"),
        F.col("close").alias("topdays"),
    )
    return raw.withColumnsRenamed({c: scalars.vendor_name(c) for c in raw.columns})


@query(
    "f20_trade_cost",
    with_views(
        "bars_m",
        """& d AS (SELECT ts_code, trade_date, (CAST(vol AS BIGINT) % 21 - 10) / 100.0::DOUBLE AS dw FROM bars_m)
        SELECT ts_code, trade_date, round(abs(dw) * (0.0003::DOUBLE + 0.0005::DOUBLE)
           + CASE WHEN dw < 0 THEN abs(dw) * 0.001::DOUBLE ELSE 0 END, 10) AS cost FROM d""",
    ),
)
def _(spark, sf):
    dw = (F.col("vol").cast("long") % 21 - 10) / 100.0
    cost = scalars.trade_cost(dw, scalars.CostRates(slippage=0.0005))
    return bars_m(spark, sf).select("ts_code", "trade_date", F.round(cost, 10).alias("cost"))


@query(
    "f21_group_cost",
    with_views(
        "bars_m",
        "&" + GROUPS_SQL[1:]
        + """SELECT rebalance_no, group_id, round(sum(greatest(dw, 0)), 8) AS buys, round(sum(greatest(-dw, 0)), 8) AS sells,
           round(sum(greatest(dw, 0)) * 0.0003::DOUBLE + sum(greatest(-dw, 0)) * 0.0013::DOUBLE, 10) AS cost FROM t GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    g = portfolio.turnover_by_group(portfolio.holdings_delta(holdings(spark, sf)))
    return g.select(
        "rebalance_no", "group_id", F.round("buys", 8).alias("buys"), F.round("sells", 8).alias("sells"), F.round("cost", 10).alias("cost")
    )
