"""W: trailing-window operators over the monthly bars (8,261 bars of 100 codes at sf0.01).

`x` is the adjusted close and null where the factor is missing, so windows with gaps are covered; `y` is volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import bars_d, bars_m, calendar, with_views
from barloom.functions import rolling as ts
from barloom.functions.scalars import adjusted
from barloom.operators import ewm, gaps, ordering, prefix, series, sliding

_P = """& p AS (SELECT ts_code, trade_date, close * adj_factor AS x, vol AS y, close * coalesce(adj_factor, 1.0) AS c,
       open, high, low FROM bars_m)
"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return bars_m(spark, sf).select(
        "ts_code",
        "trade_date",
        (F.col("close") * F.col("adj_factor")).alias("x"),
        F.col("vol").alias("y"),
        adjusted(F.col("close"), F.col("adj_factor")).alias("c"),
        "open",
        "high",
        "low",
    )


def _w(d: int | None = None) -> str:
    frame = "" if d is None else f" ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW"
    return f"OVER (PARTITION BY ts_code ORDER BY trade_date{frame})"


def _full(expr: str, x: str, d: int) -> str:
    return f"CASE WHEN count({x}) {_w(d)} = {d} THEN {expr} END"


def _register(name: str, build, sql: str, digits: int | None = 6) -> None:
    """`build(x, y, c)` gives the value column; `sql` is the same over p. Exact values are not rounded."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        value = build(F.col("x"), F.col("y"), F.col("c"))
        value = value if digits is None else F.round(value, digits)
        return panel(spark, sf).select("ts_code", "trade_date", value.alias("value"))

    value = sql if digits is None else f"round({sql}, {digits})"
    query(name, with_views("bars_m", f"{_P} SELECT ts_code, trade_date, {value} AS value FROM p"))(run)


def _register_columns(name: str, build, sql: str, digits: int = 6) -> None:
    """The same for operators that add the column `value` to the panel."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return build(panel(spark, sf)).select("ts_code", "trade_date", F.round("value", digits).alias("value"))

    query(name, with_views("bars_m", f"{_P} SELECT ts_code, trade_date, round({sql}, {digits}) AS value FROM p"))(run)


def _slide(kind: str, x: str, d: int):
    return lambda p: sliding.sliding(p, [sliding.Sliding("value", kind, x, d)])


def _weigh(kind: str, x: str, d: int):
    return lambda p: prefix.weighted(p, [prefix.Weighted("value", kind, x, d)])


def _lag(x: str, k: int) -> str:
    return x if k == 0 else f"lag({x}, {k}) {_w()}"


def _wma(x: str, d: int) -> str:
    return "(" + " + ".join(f"coalesce({_lag(x, k)}, 0.0) * {d - k}.0::DOUBLE" for k in range(d)) + f") / {d * (d + 1) // 2}.0::DOUBLE"


def _seq(y: str, d: int) -> str:
    terms = " + ".join(f"({_lag(y, k)}) * ({d - k - (d + 1) / 2})::DOUBLE" for k in range(d))
    return _full(f"({terms}) / {d * (d * d - 1) / 12}::DOUBLE", y, d)


def _list(x: str, d: int) -> str:
    return f"(list({x}) FILTER ({x} IS NOT NULL) {_w(d)})"


def _days(x: str, d: int, extreme: str) -> str:
    arr = _list(x, d)
    return f"CASE WHEN count({x}) {_w(d)} = {d} THEN CAST({d} - list_position({arr}, {extreme}({x}) {_w(d)}) AS DOUBLE) END"


_PAIR = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END"

_register("w1_delay", lambda x, y, c: ts.delay(x, 3), f"lag(x, 3) {_w()}", None)
_register("w2_delta", lambda x, y, c: ts.delta(x, 3), f"x - lag(x, 3) {_w()}", None)
_register("w3_sum", lambda x, y, c: ts.ts_sum(x, 6), _full(f"sum(x) {_w(6)}", "x", 6))
_register("w4_mean", lambda x, y, c: ts.ts_mean(x, 6), _full(f"avg(x) {_w(6)}", "x", 6))
_register("w5_std", lambda x, y, c: ts.ts_std(x, 5), _full(f"stddev_samp(x) {_w(5)}", "x", 5))
# Short windows are a sum of lags, term by term as in SQL; long ones come from prefix moments.
_register("w7_wma", lambda x, y, c: ts.wma(x, 5), _wma("x", 5))
_register_columns("w7b_decay_linear", _weigh("wma", "c", 8), _wma("c", 8))
_register_columns("w7c_wma_long", _weigh("wma", "c", 60), _wma("c", 60))
_register("w8_ts_max", lambda x, y, c: ts.ts_max(x, 6), _full(f"max(x) {_w(6)}", "x", 6), None)
_register("w8b_ts_min", lambda x, y, c: ts.ts_min(x, 6), _full(f"min(x) {_w(6)}", "x", 6), None)
def _share(x: str, d: int) -> str:
    return (
        f"CASE WHEN count(*) {_w(d)} = {d} AND {x} IS NOT NULL THEN "
        f"CAST(len(list_filter({_list(x, d)}, lambda v: v <= {x})) AS DOUBLE) / len({_list(x, d)}) END"
    )


_register_columns("w9_ts_rank", _slide("rank", "x", 8), _share("x", 8))
_register_columns("w9b_ts_rank_long", _slide("rank", "x", 60), _share("x", 60))
_register("w10_corr", lambda x, y, c: ts.ts_corr(x, y), _full(f"corr(x, y) {_w(6)}", _PAIR, 6))
_register("w11_cov", lambda x, y, c: ts.ts_cov(x, y, 6), _full(f"covar_samp(x, y) {_w(6)}", _PAIR, 6), 4)
_register(
    "w12_count",
    lambda x, y, c: ts.ts_count(x > 3000, 5),
    _full(f"sum(CAST(x > 3000 AS DOUBLE)) {_w(5)}", "(x > 3000)", 5),
)
_register(
    "w13_sumif",
    lambda x, y, c: ts.ts_sumif(y, 5, x > 3000),
    _full(f"sum(CASE WHEN x > 3000 THEN y ELSE 0.0 END) {_w(5)}", "CASE WHEN x > 3000 THEN y ELSE 0.0 END", 5),
)
_register_columns("w14_high_day", _slide("high_day", "y", 7), _days("y", 7, "max"))
_register_columns("w14b_low_day", _slide("low_day", "x", 7), _days("x", 7, "min"))
_register(
    "w15_reg_beta",
    lambda x, y, c: ts.reg_beta(x, y, 8),
    f"CASE WHEN count(*) {_w(8)} = 8 AND count({_PAIR}) {_w(8)} >= 4 THEN regr_slope(x, y) {_w(8)} END",
)
_register("w16_reg_beta_seq", lambda x, y, c: ts.reg_beta_seq(x, 6), _seq("x", 6))
_register_columns("w16b_reg_beta_seq_long", _weigh("slope", "x", 30), _seq("x", 30), 4)
_register(
    "w17_prod",
    lambda x, y, c: ts.ts_prod(x / 3000.0 - 0.1, 4),
    f"CASE WHEN count(x) {_w(4)} = 4 AND min(x / 3000.0 - 0.1) {_w(4)} > 0 "
    f"THEN product(x / 3000.0 - 0.1) {_w(4)} "
    f"WHEN count(x) {_w(4)} = 4 AND min(x / 3000.0 - 0.1) {_w(4)} = 0 THEN 0.0 END",
    5,
)
_register("w18_sum_ac", lambda x, y, c: ts.sum_ac(x), f"CASE WHEN x IS NOT NULL THEN sum(x) {_w()} END", 4)
_register("w18b_sum_ac_window", lambda x, y, c: ts.sum_ac(x, 6), _full(f"sum(x) {_w(6)}", "x", 6))
_register("w19_return", lambda x, y, c: ts.simple_return(c), f"c / lag(c) {_w()} - 1.0::DOUBLE")


@query(
    "w4b_mean_cross_section",
    with_views(
        "bars_m", _P + " SELECT ts_code, trade_date, round(avg(x) OVER (PARTITION BY trade_date), 4) AS value FROM p"
    ),
)
def _(spark, sf):
    out = ordering.with_group_stats(panel(spark, sf), ["trade_date"], {"value": F.avg("x")})
    return out.select("ts_code", "trade_date", F.round("value", 4).alias("value"))


@query(
    "w6_sma",
    with_views(
        "bars_m",
        _P
        + """, s AS (SELECT *, list(x) FILTER (x IS NOT NULL) OVER (PARTITION BY ts_code ORDER BY trade_date) AS xs FROM p)
        SELECT ts_code, trade_date, CASE WHEN x IS NOT NULL THEN
               round(list_reduce(xs, lambda a, v: a * 0.75::DOUBLE + v * 0.25::DOUBLE), 6) END AS value FROM s""",
    ),
)
def _(spark, sf):
    return ewm.sma(panel(spark, sf), "x", 8, 2, "value").select(
        "ts_code", "trade_date", F.round("value", 6).alias("value")
    )


@query(
    "w20_momentum",
    with_views(
        "bars_m",
        _P
        + f""", m AS (SELECT ts_code, trade_date, c / lag(c, 20) {_w()} - 1.0::DOUBLE AS value FROM p)
        SELECT ts_code, trade_date, round(value, 6) AS value FROM m WHERE value IS NOT NULL""",
    ),
)
def _(spark, sf):
    from barloom.plans.factors import Momentum

    return Momentum(20).compute(panel_bars(spark, sf)).select("ts_code", "trade_date", F.round("value", 6).alias("value"))


def panel_bars(spark, sf):
    b = bars_m(spark, sf)
    return b.withColumn("close_adj", adjusted(F.col("close"), F.col("adj_factor")))


@query(
    "w21_volatility",
    with_views(
        "bars_m",
        _P
        + f""", r AS (SELECT ts_code, trade_date, c / lag(c) {_w()} - 1.0::DOUBLE AS ret FROM p),
        v AS (SELECT ts_code, trade_date, CASE WHEN count(ret) {_w(60)} >= 30 THEN stddev_samp(ret) {_w(60)} END AS value FROM r)
        SELECT ts_code, trade_date, round(value, 6) AS value FROM v WHERE value IS NOT NULL""",
    ),
)
def _(spark, sf):
    from barloom.plans.factors import Volatility

    return Volatility(60, 30).compute(panel_bars(spark, sf)).select(
        "ts_code", "trade_date", F.round("value", 6).alias("value")
    )


@query(
    "w22_gap_ranges",
    with_views(
        "bars_m listing",
        """& days AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n
              FROM (SELECT DISTINCT trade_date FROM bars_m)),
        missing AS (SELECT c.ts_code, d.trade_date, d.n FROM (SELECT DISTINCT ts_code FROM bars_m) c, days d
              WHERE NOT EXISTS (SELECT 1 FROM bars_m b WHERE b.ts_code = c.ts_code AND b.trade_date = d.trade_date
                                AND b.close > 1500)),
        isl AS (SELECT *, n - row_number() OVER (PARTITION BY ts_code ORDER BY n) AS island FROM missing)
        SELECT ts_code, min(trade_date) AS gap_start, max(trade_date) AS gap_end, count(*) AS n_days
        FROM isl GROUP BY ts_code, island""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf)
    days = b.select("trade_date").distinct()
    life = b.select("ts_code").distinct().withColumns(
        {"list_date": F.lit("00000000"), "delist_date": F.lit(None).cast("string")}
    )
    missing = gaps.missing_days(life, days, b.where(F.col("close") > 1500))
    return gaps.merge_consecutive(missing, days)


@query(
    "w23_effective_end",
    with_views(
        "bars_m listing",
        """& d AS (SELECT trade_date, count(*) FILTER (close > 1500) AS n, count(*) AS expected FROM bars_m GROUP BY 1),
        e AS (SELECT max(trade_date) FILTER (n >= 0.95 * expected) AS good,
                     max(trade_date) AS last_open FROM d WHERE trade_date <= '20011031'),
        p AS (SELECT max(trade_date) AS prev FROM d, e WHERE trade_date < last_open)
        SELECT coalesce(good, prev) AS effective_end FROM e, p""",
    ),
)
def _(spark, sf):
    per_day = (
        bars_m(spark, sf)
        .groupBy("trade_date")
        .agg(F.count_if(F.col("close") > 1500).alias("n"), F.count(F.lit(1)).alias("expected"))
    )
    return gaps.effective_end(per_day, "20011031")


@query(
    "w24_nav",
    with_views(
        "bars_m",
        """& r AS (SELECT trade_date, round(avg(close / open - 1.0::DOUBLE), 8) AS r FROM bars_m GROUP BY 1)
        SELECT trade_date, round(product(1.0::DOUBLE + r * 0.01) OVER (ORDER BY trade_date), 6) AS nav FROM r""",
    ),
)
def _(spark, sf):
    r = bars_m(spark, sf).groupBy("trade_date").agg(
        (F.round(F.avg(F.col("close") / F.col("open") - 1.0), 8) * 0.01).alias("r")
    )
    return series.nav(r, "r").select("trade_date", F.round("nav", 6).alias("nav"))


@query(
    "w25_rebalance_month",
    with_views(
        "calendar",
        "SELECT substr(cal_date, 1, 6) AS period, max(cal_date) AS trade_date FROM calendar WHERE is_open = '1' GROUP BY 1",
    ),
)
def _(spark, sf):
    from barloom.operators.spine import last_of_period

    return last_of_period(calendar(spark, sf).where("is_open = '1'").select(F.col("cal_date").alias("trade_date")), "monthly")


@query(
    "w25b_rebalance_week",
    with_views(
        "calendar",
        """SELECT strftime(strptime(cal_date, '%Y%m%d'), '%G%V') AS period, max(cal_date) AS trade_date
        FROM calendar WHERE is_open = '1' GROUP BY 1""",
    ),
)
def _(spark, sf):
    from barloom.operators.spine import last_of_period

    return last_of_period(calendar(spark, sf).where("is_open = '1'").select(F.col("cal_date").alias("trade_date")), "weekly")


@query(
    "w19b_daily_return",
    with_views(
        "bars_d",
        f"""& p AS (SELECT ts_code, trade_date, close * coalesce(adj_factor, 1.0) AS c FROM bars_d)
        SELECT ts_code, trade_date, round(c / lag(c) {_w()} - 1.0::DOUBLE, 6) AS ret FROM p""",
    ),
)
def _(spark, sf):
    c = adjusted(F.col("close"), F.col("adj_factor"))
    return bars_d(spark, sf).select("ts_code", "trade_date", F.round(ts.simple_return(c), 6).alias("ret"))
