"""C and X: whole jobs and plug-ins."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.catalog.aggregates import LOG_SQL, due_periods, missing_log
from barloom.catalog.dedup import PERIODS_SQL
from barloom.catalog.joins import _GRID_SQL, FACTORS_SQL, LISTED_SQL, factors_long
from barloom.catalog.nested import DOC_SQL, landed_reports
from barloom.catalog.predicates import FULL_DAY_SQL, LIMIT_SQL
from barloom.catalog.registry import query
from barloom.catalog.scalars import ADJ_SQL, DIRECTIONAL_SQL
from barloom.catalog.scans import VENDOR_SQL, bar_root, vendor_wide
from barloom.catalog.views import bars_d, bars_m, calendar, companies, index_m, landing, listing, market, reports, suspend, table, with_views
from barloom.functions import rolling as ts
from barloom.functions.per_code import apply_per_code
from barloom.operators import completeness, dedup, merge, nested, ordering, profile, series, universe
from barloom.plans import alphas, backtest, completeness_jobs, detail, export_gate, factor_meta, factors, loads, panel, upkeep
from barloom.session import scratch_path, stage
from barloom.sources import bars as B
from barloom.sources import sinks
from barloom.sources.contracts import REPORT_INCOME, Contract

# ── panel, factors, alphas ───────────────────────────────────────────────


@query(
    "c1_panel",
    with_views(
        "bars_m index_m",
        ADJ_SQL
        + DIRECTIONAL_SQL
        + """SELECT a.ts_code, a.trade_date, c AS close_adj, CASE WHEN vol > 0 THEN amount * 10.0::DOUBLE / vol END AS vwap,
          round(c / lag(c) OVER (PARTITION BY a.ts_code ORDER BY a.trade_date) - 1.0::DOUBLE, 8) AS ret, dtm, dbm, hd, ld, tr,
          i.open AS benchmark_open, i.close AS benchmark_close
        FROM adj a JOIN dir d ON a.ts_code = d.ts_code AND a.trade_date = d.trade_date
        LEFT JOIN index_m i ON i.trade_date = a.trade_date AND i.ts_code = '000300.SH'""",
    ),
)
def _(spark, sf):
    p = panel.build(bars_m(spark, sf), index_m(spark, sf))
    return p.select(
        "ts_code", "trade_date", "close_adj", "vwap", F.round("ret", 8).alias("ret"), "dtm", "dbm", "hd", "ld", "tr",
        "benchmark_open", "benchmark_close",
    )


_W = "OVER (PARTITION BY ts_code ORDER BY trade_date"


def _f(d: int) -> str:
    return f"{_W} ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


ALPHA_SQL = (
    ADJ_SQL
    + DIRECTIONAL_SQL
    + f""", px AS (SELECT a.*, d.dtm, d.dbm, d.tr, c / lag(c) {_W.replace('ts_code', 'a.ts_code', 1).replace('ORDER BY trade_date', 'ORDER BY a.trade_date')}) - 1.0::DOUBLE AS ret
        FROM adj a JOIN dir d ON a.ts_code = d.ts_code AND a.trade_date = d.trade_date),
  rk AS (SELECT *, (rank() OVER (PARTITION BY trade_date ORDER BY vol) + (count(*) OVER (PARTITION BY trade_date, vol) - 1) / 2.0::DOUBLE)
          / count(vol) OVER (PARTITION BY trade_date) AS rank_vol,
        CASE WHEN ret IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date, ret IS NULL ORDER BY ret)
          + (count(*) OVER (PARTITION BY trade_date, ret) - 1) / 2.0::DOUBLE) / count(ret) OVER (PARTITION BY trade_date) END AS rank_ret FROM px),
  al AS (SELECT ts_code, trade_date,
     -(c - lag(c, 5) {_W})) / c AS demo_reversal,
     CASE WHEN count(*) {_f(6)} = 6 THEN corr(c, vol) {_f(6)} END AS demo_price_volume,
     CASE WHEN count(*) {_f(9)} = 9 THEN (c - min(l) {_f(9)}) / nullif(max(h) {_f(9)} - min(l) {_f(9)}, 0) END AS demo_range,
     (coalesce(ret, 0) * 4 + coalesce(lag(ret, 1) {_W}), 0) * 3 + coalesce(lag(ret, 2) {_W}), 0) * 2 + coalesce(lag(ret, 3) {_W}), 0)) / 10 AS demo_decay,
     CASE WHEN count(ret) {_f(6)} = 6 THEN sum(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) {_f(6)} / 6.0::DOUBLE END AS demo_up_share,
     CASE WHEN count(*) {_f(5)} = 5 THEN (sum(dtm) {_f(5)} - sum(dbm) {_f(5)}) / c END AS demo_directional,
     rank_vol - rank_ret AS demo_rank_gap,
     CASE WHEN count(rank_ret) {_f(5)} = 5 AND min(rank_vol) {_f(5)} < max(rank_vol) {_f(5)} AND min(rank_ret) {_f(5)} < max(rank_ret) {_f(5)}
          THEN corr(rank_vol, rank_ret) {_f(5)} END AS demo_rank_corr,
     CASE WHEN c > o THEN (c - o) / o ELSE 0.0::DOUBLE END AS demo_text,
     CASE WHEN ret > 0.1 THEN 0.0::DOUBLE ELSE tr / c END AS demo_self FROM rk),
  un AS (UNPIVOT al ON COLUMNS(* EXCLUDE (ts_code, trade_date)) INTO NAME factor_name VALUE value)
"""
)


@query(
    "c2_alpha_batch",
    with_views("bars_m", ALPHA_SQL + "SELECT ts_code, trade_date, factor_name, CASE WHEN round(value, 6) = 0 THEN 0.0::DOUBLE ELSE round(value, 6) END AS value FROM un WHERE value IS NOT NULL"),
)
def _(spark, sf):
    p = stage(panel.build(bars_m(spark, sf)))
    out = alphas.compute(p, alphas.demo())
    return out.select("ts_code", "trade_date", "factor_name", F.round("value", 6).alias("value"))


@query(
    "c2b_alpha_month",
    with_views(
        "bars_m",
        ALPHA_SQL
        + """SELECT ts_code, trade_date, factor_name, CASE WHEN round(value, 6) = 0 THEN 0.0::DOUBLE ELSE round(value, 6) END AS value FROM un WHERE value IS NOT NULL
        AND substr(trade_date, 1, 6) = '199910' AND factor_name <> 'demo_decay'""",
    ),
)
def _(spark, sf):
    """One month with look-back; an alpha that is stored already is left out."""
    root = bar_root(spark, sf)
    p = stage(panel.build(B.BarStore(spark, root).read_month_with_window("199910", alphas.LOOKBACK_DAYS)))
    have = spark.createDataFrame([("demo_decay", "199910"), ("demo_range", "199909")], "factor_name string, dt string")
    todo = alphas.pending(alphas.demo(), have, "199910")
    sinks.write_factors(alphas.compute(p, todo, "199910"), root)
    f = B.FactorStore(spark, root).table()
    return f.select("ts_code", "trade_date", "factor_name", F.round("value", 6).alias("value"))


_MOM = f"""& p AS (SELECT ts_code, trade_date, close * coalesce(adj_factor, 1.0) AS c FROM bars_m),
  m AS (SELECT ts_code, trade_date, c / lag(c, 20) {_W}) - 1.0::DOUBLE AS value FROM p)
"""


@query(
    "c3_factor_month",
    with_views("bars_m", _MOM + "SELECT 'momentum_20' AS factor_name, ts_code, trade_date, round(value, 6) AS value FROM m WHERE value IS NOT NULL AND substr(trade_date, 1, 6) = '199910'"),
)
def _(spark, sf):
    """Monthly bars stand for daily ones here, so the look-back is given in months."""

    @dataclass(frozen=True)
    class MonthlyMomentum(factors.Momentum):
        def meta(self):
            return factors.FactorMeta("momentum_20", 20 * B.DAYS_PER_MONTH)

    store = B.BarStore(spark, bar_root(spark, sf))
    out = factors.compute_month(MonthlyMomentum(20), store, "199910")
    return out.withColumn("value", F.round("value", 6))


@query(
    "c4_months_to_compute",
    with_views(
        "bars_m",
        """SELECT DISTINCT substr(trade_date, 1, 6) AS dt FROM bars_m WHERE substr(trade_date, 1, 6) BETWEEN '199604' AND '200012'
        AND substr(trade_date, 5, 2) NOT IN ('02', '07')""",
    ),
)
def _(spark, sf):
    months = B.BarStore(spark, bar_root(spark, sf)).months()
    have = months.where(F.substring("dt", 5, 2).isin("02", "07"))
    return factors.months_to_compute(months, have, "199604", "200012")


# ── backtest ─────────────────────────────────────────────────────────────

_START, _END = "19960101", "20001231"
_BT = f"""& opens AS (SELECT cal_date AS day FROM calendar WHERE is_open = '1' AND cal_date BETWEEN '{_START}' AND '{_END}'),
  reb AS (SELECT td, row_number() OVER (ORDER BY td) AS no, lead(td) OVER (ORDER BY td) AS nxt
          FROM (SELECT max(day) AS td FROM opens GROUP BY substr(day, 1, 6))),
  days AS (SELECT td, no, day, row_number() OVER (PARTITION BY no ORDER BY day) AS dn FROM reb JOIN opens ON day > td AND day <= nxt),
  adj AS (SELECT ts_code, trade_date, close, up_limit, down_limit, vol, close * coalesce(adj_factor, 1.0) AS c FROM bars_d),
  ranged AS (SELECT * FROM adj WHERE trade_date BETWEEN '{_START}' AND '{_END}'),
  rets AS (SELECT * FROM (SELECT ts_code, trade_date AS day, c / lag(c) {_W}) - 1.0::DOUBLE AS ret FROM ranged) WHERE ret IS NOT NULL),
  fac AS (SELECT ts_code, trade_date, c / lag(c, 5) {_W}) - 1.0::DOUBLE AS mom5, CASE WHEN CAST(vol AS BIGINT) % 4 <> 0 THEN vol END AS volume FROM adj),
  base AS (SELECT f.*, r.no FROM fac f JOIN reb r ON f.trade_date = r.td AND r.nxt IS NOT NULL WHERE mom5 IS NOT NULL),
  {{scored}},
  inv AS (SELECT s.* FROM scored s JOIN listing l ON l.ts_code = s.ts_code AND l.exchange IN ('SSE', 'SZSE', 'BSE')
       AND {LISTED_SQL.format(l='l', d='s.trade_date')} AND upper(l.name) NOT LIKE '%ST%'
       AND l.list_date <= strftime(CAST(strptime(s.trade_date, '%Y%m%d') AS DATE) - 60, '%Y%m%d')
       WHERE NOT EXISTS (SELECT 1 FROM suspend x WHERE x.ts_code = s.ts_code AND x.trade_date = s.trade_date AND {FULL_DAY_SQL})),
  grp AS (SELECT *, ntile(3) OVER (PARTITION BY trade_date ORDER BY value DESC, ts_code) - 1 AS g FROM inv),
  tgt AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, g) AS w FROM grp),
  kept AS (SELECT t.* FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM ranged b WHERE b.ts_code = t.ts_code AND b.trade_date = t.trade_date AND {LIMIT_SQL})),
  held AS MATERIALIZED (SELECT trade_date, no, 'G' || g AS group_id, ts_code, w / sum(w) OVER (PARTITION BY trade_date, g) AS weight FROM kept),
  used AS (SELECT DISTINCT trade_date, no FROM base),
  tr0 AS (SELECT coalesce(a.no, b.no + 1) AS no, coalesce(a.group_id, b.group_id) AS group_id, coalesce(a.ts_code, b.ts_code) AS ts_code,
        coalesce(a.weight, 0) - coalesce(b.weight, 0) AS dw FROM held a FULL JOIN held b
        ON a.no = b.no + 1 AND a.group_id = b.group_id AND a.ts_code = b.ts_code),
  trades AS (SELECT u.trade_date, t.* FROM tr0 t JOIN used u ON u.no = t.no WHERE abs(dw) >= 1e-12),
  bg AS (SELECT no, group_id, sum(greatest(dw, 0)) AS buys, sum(greatest(-dw, 0)) AS sells FROM trades GROUP BY 1, 2),
  cost AS (SELECT *, buys * 0.0003::DOUBLE + sells * (0.0003::DOUBLE + 0.001::DOUBLE) AS cost FROM bg),
  turn AS (SELECT u.trade_date, coalesce(sum(buys + sells), 0) / 3 AS turnover FROM used u LEFT JOIN bg USING (no) GROUP BY 1),
  gr AS (SELECT d.day, h.group_id, sum(h.weight * r.ret) AS r FROM days d JOIN held h ON h.no = d.no JOIN rets r ON r.ts_code = h.ts_code AND r.day = d.day GROUP BY 1, 2),
  spine AS (SELECT d.day, d.no, d.dn, gid AS group_id FROM days d JOIN used u ON u.no = d.no, (SELECT unnest(['G0', 'G1', 'G2']) AS gid)),
  net AS (SELECT s.day, s.group_id, coalesce(gr.r, 0) - CASE WHEN dn = 1 THEN coalesce(cost.cost, 0) ELSE 0 END AS r
        FROM spine s LEFT JOIN gr ON gr.day = s.day AND gr.group_id = s.group_id LEFT JOIN cost ON cost.no = s.no AND cost.group_id = s.group_id),
  returns AS MATERIALIZED (SELECT day AS trade_date, max(r) FILTER (group_id = 'G0') AS G0, max(r) FILTER (group_id = 'G1') AS G1, max(r) FILTER (group_id = 'G2') AS G2,
        max(r) FILTER (group_id = 'G0') - max(r) FILTER (group_id = 'G2') AS long_short FROM net GROUP BY 1),
  fwd AS (SELECT d.td AS trade_date, r.ts_code, product(1.0::DOUBLE + r.ret) - 1.0::DOUBLE AS fr FROM days d JOIN rets r ON r.day = d.day GROUP BY 1, 2),
  pairs AS (SELECT i.trade_date, i.ts_code, value, fr FROM inv i JOIN fwd USING (trade_date, ts_code)),
  pr AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY value) + (count(*) OVER (PARTITION BY trade_date, value) - 1) / 2.0::DOUBLE AS rv,
        rank() OVER (PARTITION BY trade_date ORDER BY fr) + (count(*) OVER (PARTITION BY trade_date, fr) - 1) / 2.0::DOUBLE AS rf FROM pairs),
  ic AS (SELECT u.trade_date, CASE WHEN count(value) >= 3 THEN corr(value, fr) END AS ic, CASE WHEN count(value) >= 3 THEN corr(rv, rf) END AS rank_ic
        FROM used u LEFT JOIN pr USING (trade_date) GROUP BY 1)
"""
_SINGLE = _BT.replace("{scored}", "scored AS (SELECT ts_code, trade_date, no, mom5 AS value FROM base)")
_MULTI = _BT.replace(
    "{scored}",
    """st AS (SELECT *, avg(mom5) OVER d AS m1, stddev_samp(mom5) OVER d AS s1, avg(volume) OVER d AS m2, stddev_samp(volume) OVER d AS s2
          FROM base WINDOW d AS (PARTITION BY trade_date)),
  zz AS (SELECT ts_code, trade_date, no, CASE WHEN s1 > 0 THEN (mom5 - m1) / s1 ELSE 0.0 END AS z1,
          CASE WHEN volume IS NOT NULL THEN CASE WHEN s2 > 0 THEN (volume - m2) / s2 ELSE 0.0 END END AS z2 FROM st),
  scored AS (SELECT ts_code, trade_date, no, (z1 * 0.6::DOUBLE + coalesce(z2 * 0.4::DOUBLE, 0.0))
          / (0.6::DOUBLE + CASE WHEN z2 IS NOT NULL THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM zz)""",
)
_VIEWS = "bars_d listing calendar suspend"


def run_backtest(spark, sf, strategy=None, freq="monthly"):
    m = market(spark, sf, bars=True)
    b = m.bars.select("ts_code", "trade_date", "close", "adj_factor", "up_limit", "down_limit", "vol")
    c = F.col("close") * F.coalesce(F.col("adj_factor"), F.lit(1.0))
    wide = b.select(
        "ts_code",
        "trade_date",
        ts.momentum(c, 5).alias("mom5"),
        F.when(F.col("vol").cast("long") % 4 != 0, F.col("vol")).alias("volume"),
    )
    return backtest.Backtest(
        b, wide, m.listing, m.calendar, m.suspend,
        strategy or backtest.SingleFactor("mom5", 3), _START, _END, freq,
    )


def _r(df, digits=6):
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query("c5_backtest_portfolio", with_views(_VIEWS, _SINGLE + "SELECT trade_date, group_id, ts_code, round(weight, 6) AS weight FROM held"))
def _(spark, sf):
    return _r(run_backtest(spark, sf).portfolio)


@query("c5b_backtest_trades", with_views(_VIEWS, _SINGLE + """SELECT trade_date, group_id, ts_code, round(dw, 6) AS delta_weight,
    round(abs(dw) * 0.0003::DOUBLE + CASE WHEN dw < 0 THEN abs(dw) * 0.001::DOUBLE ELSE 0 END, 9) AS cost FROM trades"""))
def _(spark, sf):
    t = run_backtest(spark, sf).trades
    return t.withColumns({"delta_weight": F.round("delta_weight", 6), "cost": F.round("cost", 9)})


@query("c5c_backtest_turnover", with_views(_VIEWS, _SINGLE + "SELECT trade_date, round(turnover, 6) AS turnover FROM turn"))
def _(spark, sf):
    return _r(run_backtest(spark, sf).turnover)


@query("c5d_backtest_ic", with_views(_VIEWS, _SINGLE + "SELECT trade_date, round(ic, 6) AS ic, round(rank_ic, 6) AS rank_ic FROM ic"))
def _(spark, sf):
    return _r(run_backtest(spark, sf).ic)


@query("c6_group_returns", with_views(_VIEWS, _SINGLE + "SELECT trade_date, CASE WHEN round(G0, 6) = 0 THEN 0.0::DOUBLE ELSE round(G0, 6) END AS G0, CASE WHEN round(G1, 6) = 0 THEN 0.0::DOUBLE ELSE round(G1, 6) END AS G1, CASE WHEN round(G2, 6) = 0 THEN 0.0::DOUBLE ELSE round(G2, 6) END AS G2, CASE WHEN round(long_short, 6) = 0 THEN 0.0::DOUBLE ELSE round(long_short, 6) END AS long_short FROM returns"))
def _(spark, sf):
    return _r(run_backtest(spark, sf).returns)


@query("c6b_multi_factor_returns", with_views(_VIEWS, _MULTI + "SELECT trade_date, CASE WHEN round(G0, 6) = 0 THEN 0.0::DOUBLE ELSE round(G0, 6) END AS G0, CASE WHEN round(G1, 6) = 0 THEN 0.0::DOUBLE ELSE round(G1, 6) END AS G1, CASE WHEN round(G2, 6) = 0 THEN 0.0::DOUBLE ELSE round(G2, 6) END AS G2, CASE WHEN round(long_short, 6) = 0 THEN 0.0::DOUBLE ELSE round(long_short, 6) END AS long_short FROM returns"))
def _(spark, sf):
    return _r(run_backtest(spark, sf, backtest.MultiFactor({"mom5": 0.6, "volume": 0.4}, 3)).returns)


@query(
    "c6c_weekly_turnover",
    with_views(
        _VIEWS,
        _SINGLE.replace("GROUP BY substr(day, 1, 6)", "GROUP BY strftime(strptime(day, '%Y%m%d'), '%G%V')")
        + "SELECT trade_date, round(turnover, 6) AS turnover FROM turn",
    ),
)
def _(spark, sf):
    return _r(run_backtest(spark, sf, freq="weekly").turnover)


_DAMPED = ", damped AS (SELECT trade_date, " + ", ".join(f"{c} * 0.01::DOUBLE AS {c}" for c in ("G0", "G1", "G2", "long_short")) + " FROM returns)"


def damped_run(spark, sf):
    """A run with a hundredth of its daily returns: the given prices are noise, and their NAV would leave every scale."""
    res = run_backtest(spark, sf)
    res.returns = stage(res.returns.withColumns({c: F.col(c) * 0.01 for c in [*res.groups, "long_short"]}))
    return res


_SUMMARY_SQL = """, n AS (SELECT trade_date, long_short AS r, product(1.0::DOUBLE + long_short) OVER (ORDER BY trade_date) AS nav FROM damped),
  pk AS (SELECT *, greatest(1.0::DOUBLE, max(nav) OVER (ORDER BY trade_date)) AS peak FROM n),
  ls AS (SELECT count(*) AS n_days, product(1.0::DOUBLE + r) AS total, avg(r) AS m, stddev_samp(r) AS s, least(0.0::DOUBLE, min(nav / peak - 1.0::DOUBLE)) AS mdd FROM pk),
  tp AS (SELECT avg(G0) / stddev_samp(G0) * sqrt(252.0::DOUBLE) AS sharpe FROM damped),
  su AS (SELECT avg(ic) AS ic_mean, avg(rank_ic) AS rank_ic_mean, avg(ic) / stddev_samp(ic) AS icir, avg(rank_ic) / stddev_samp(rank_ic) AS rank_icir FROM ic),
  tu AS (SELECT avg(turnover) AS avg_turnover, count(*) AS n_rebalance FROM turn)
  SELECT round(ic_mean, 6) AS ic_mean, round(rank_ic_mean, 6) AS rank_ic_mean, round(icir, 5) AS icir, round(rank_icir, 5) AS rank_icir, n_days,
    round(CASE WHEN total >= 0 THEN pow(total, 252.0::DOUBLE / n_days) - 1.0::DOUBLE END, 6) AS annual_return, round(m / s * sqrt(252.0::DOUBLE), 5) AS sharpe,
    round(mdd, 6) AS mdd, round(CASE WHEN total >= 0 AND mdd < 0 THEN (pow(total, 252.0::DOUBLE / n_days) - 1.0::DOUBLE) / abs(mdd) END, 5) AS calmar,
    round(tp.sharpe, 5) AS top_group_sharpe, round(avg_turnover, 6) AS avg_turnover, n_rebalance
  FROM ls, tp, su, tu"""


@query("c5e_backtest_summary", with_views(_VIEWS, _SINGLE + _DAMPED + _SUMMARY_SQL))
def _(spark, sf):
    s = backtest.summary(damped_run(spark, sf))
    five = {"icir", "rank_icir", "sharpe", "calmar", "top_group_sharpe"}
    return s.withColumns({c: F.round(c, 5 if c in five else 6) for c, t in s.dtypes if t == "double"})


@query(
    "s19_backtest_sink",
    with_views(
        _VIEWS,
        _SINGLE
        + """SELECT 'portfolio' AS table_name, trade_date, group_id || ' ' || ts_code AS item, round(weight, 6) AS value FROM held
        UNION ALL SELECT 'trades', trade_date, group_id || ' ' || ts_code, round(dw, 6) FROM trades
        UNION ALL SELECT 'cost', trade_date, group_id || ' ' || ts_code, round(abs(dw) * 0.0003::DOUBLE + CASE WHEN dw < 0 THEN abs(dw) * 0.001::DOUBLE ELSE 0 END, 9) FROM trades
        UNION ALL (SELECT 'returns', trade_date, name, CASE WHEN round(value, 6) = 0 THEN 0.0::DOUBLE ELSE round(value, 6) END
          FROM (UNPIVOT (SELECT trade_date, G0, G1, G2, long_short FROM returns) ON G0, G1, G2, long_short))
        UNION ALL SELECT 'ic', trade_date, 'ic', round(ic, 6) FROM ic UNION ALL SELECT 'ic', trade_date, 'rank_ic', round(rank_ic, 6) FROM ic
        UNION ALL SELECT 'turnover', trade_date, '', round(turnover, 6) FROM turn
        UNION ALL SELECT 'report', NULL, 'n_rebalance', CAST(count(*) AS DOUBLE) FROM turn""",
    ),
)
def _(spark, sf):
    """Every value that the sink wrote, read back."""
    res = run_backtest(spark, sf)
    root = scratch_path(spark, "backtest")
    sinks.write_backtest(res, backtest.summary(res, {"strategy": "single_factor_mom5"}), root)
    stored = lambda t: spark.read.parquet(f"{root}/{t}")
    row = lambda df, name, item, value: df.select(F.lit(name).alias("table_name"), "trade_date", item.alias("item"), value.alias("value"))
    held_by, col = F.concat_ws(" ", "group_id", "ts_code"), lambda c, n=6: F.round(c, n)
    returns = stored("returns").unpivot(["trade_date"], [*res.groups, "long_short"], "name", "v")
    report = spark.read.schema("n_rebalance double").json(f"{root}/report").withColumn("trade_date", F.lit(None).cast("string"))
    parts = [
        row(stored("portfolio"), "portfolio", held_by, col("weight")),
        row(stored("trades"), "trades", held_by, col("delta_weight")),
        row(stored("trades"), "cost", held_by, col("cost", 9)),
        row(returns, "returns", F.col("name"), col("v")),
        row(stored("ic"), "ic", F.lit("ic"), col("ic")),
        row(stored("ic"), "ic", F.lit("rank_ic"), col("rank_ic")),
        row(stored("turnover"), "turnover", F.lit(""), col("turnover")),
        row(report, "report", F.lit("n_rebalance"), F.col("n_rebalance")),
    ]
    return reduce(DataFrame.unionByName, parts)


_RETURNS_OF = _SINGLE + _DAMPED + """, closes AS (SELECT trade_date, close FROM index_m WHERE ts_code = '000300.SH'),
  f0 AS (SELECT min(trade_date) AS d0 FROM damped),
  basis AS (SELECT coalesce((SELECT max_by(close, trade_date) FROM closes, f0 WHERE trade_date <= d0),
                (SELECT min_by(close, trade_date) FROM closes SEMI JOIN damped USING (trade_date))) AS b),
  bmk AS (SELECT r.trade_date, coalesce(last_value(c.close IGNORE NULLS) OVER (ORDER BY r.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b) / b AS v
        FROM damped r CROSS JOIN basis LEFT JOIN closes c USING (trade_date)),
  lsn AS (SELECT trade_date, product(1.0::DOUBLE + long_short) OVER (ORDER BY trade_date) AS v FROM damped),
  curves AS (SELECT 'long_short' AS curve, trade_date, v FROM lsn
     UNION ALL SELECT 'top', trade_date, product(1.0::DOUBLE + G0) OVER (ORDER BY trade_date) FROM damped
     UNION ALL SELECT 'bottom', trade_date, product(1.0::DOUBLE + G2) OVER (ORDER BY trade_date) FROM damped
     UNION ALL SELECT 'benchmark', trade_date, v FROM bmk
     UNION ALL SELECT 'excess', trade_date, lsn.v / bmk.v FROM lsn JOIN bmk USING (trade_date) WHERE bmk.v <> 0)
"""


@query("c8_nav_curves", with_views(_VIEWS + " index_m", _RETURNS_OF + "SELECT curve, trade_date, round(v, 5) AS value FROM curves"))
def _(spark, sf):
    res = damped_run(spark, sf)
    closes = index_m(spark, sf).where("ts_code = '000300.SH'")
    return _r(detail.nav_curves(res.returns, res.groups, closes), 5)


@query(
    "c8b_group_totals",
    with_views(
        _VIEWS,
        _SINGLE
        + _DAMPED
        + """SELECT 'G0' AS group_id, round(product(1.0::DOUBLE + G0), 5) AS final_nav, round(product(1.0::DOUBLE + G0) - 1.0::DOUBLE, 5) AS total_return FROM damped
        UNION ALL SELECT 'G1', round(product(1.0::DOUBLE + G1), 5), round(product(1.0::DOUBLE + G1) - 1.0::DOUBLE, 5) FROM damped
        UNION ALL SELECT 'G2', round(product(1.0::DOUBLE + G2), 5), round(product(1.0::DOUBLE + G2) - 1.0::DOUBLE, 5) FROM damped""",
    ),
)
def _(spark, sf):
    res = damped_run(spark, sf)
    return _r(series.group_totals(res.returns, res.groups), 5)


@query(
    "c8c_yearly_metrics",
    with_views(
        _VIEWS,
        _SINGLE
        + _DAMPED
        + """, n AS (SELECT *, long_short AS r, substr(trade_date, 1, 4) AS year, product(1.0::DOUBLE + long_short) OVER (PARTITION BY substr(trade_date, 1, 4) ORDER BY trade_date) AS nav FROM damped),
        pk AS (SELECT *, greatest(1.0::DOUBLE, max(nav) OVER (PARTITION BY year ORDER BY trade_date)) AS peak FROM n),
        q AS (SELECT year, count(*) AS n_days, product(1.0::DOUBLE + r) AS total, avg(r) / stddev_samp(r) AS s, least(0.0::DOUBLE, min(nav / peak - 1.0::DOUBLE)) AS mdd FROM pk GROUP BY 1)
        SELECT year, n_days, round(pow(total, 252.0::DOUBLE / n_days) - 1.0::DOUBLE, 5) AS annual_return, round(s * sqrt(252.0::DOUBLE), 5) AS sharpe,
          round(mdd, 5) AS mdd FROM q""",
    ),
)
def _(spark, sf):
    return _r(detail.yearly(damped_run(spark, sf).returns).drop("calmar"), 5)


# ── export gate, completeness ────────────────────────────────────────────

_GATE_SQL = """& d AS (SELECT trade_date, count(*) FILTER (vol > 60) AS n, count(*) AS expected FROM bars_m GROUP BY 1),
  g AS (SELECT substr(trade_date, 1, 6) AS month, count(*) FILTER ((substr(trade_date, 1, 6) <> '200011' OR trade_date < '20001130')
        AND n < 0.99 * expected) AS short_days FROM d WHERE substr(trade_date, 1, 6) BETWEEN '199601' AND '200112' GROUP BY 1),
  dec AS (SELECT month, short_days, CASE WHEN short_days = 0 THEN 'write' WHEN month = '200011' THEN 'write_with_warning' ELSE 'skip' END AS decision
     FROM g WHERE month = '200011' OR substr(month, 5) NOT IN ('01', '11'))
"""


def _gate(spark, sf):
    d = bars_m(spark, sf).groupBy("trade_date").agg(F.count_if(F.col("vol") > 60).alias("n"), F.count(F.lit(1)).alias("expected"))
    have = d.select(F.substring("trade_date", 1, 6).alias("dt")).where(F.substring("dt", 5, 2).isin("01", "11"))
    return export_gate.gate(d, have, "20001130", "199601", "200112")


@query("c9_export_gate", with_views("bars_m", _GATE_SQL + "SELECT * FROM dec"))
def _(spark, sf):
    return _gate(spark, sf)


@query(
    "c9b_export",
    with_views("bars_m", _GATE_SQL + "SELECT ts_code, trade_date, close, vol, substr(trade_date, 1, 6) AS dt FROM bars_m WHERE substr(trade_date, 1, 6) IN (SELECT month FROM dec WHERE decision <> 'skip')"),
)
def _(spark, sf):
    root = scratch_path(spark, "warehouse")
    export_gate.export(bars_m(spark, sf), _gate(spark, sf), root)
    return B.BarStore(spark, root).table().select("ts_code", "trade_date", "close", "vol", "dt")


_CYCLE_SQL = """& dd AS (SELECT DISTINCT ts_code, trade_date FROM landing), tb AS (SELECT DISTINCT ts_code, trade_date FROM landing WHERE value > 12),
  ex AS (SELECT trade_date AS date_key, count(*) AS expected FROM dd GROUP BY 1),
  b AS (SELECT ex.date_key, expected, count(tb.ts_code) AS n FROM ex LEFT JOIN tb ON tb.trade_date = ex.date_key GROUP BY 1, 2)
"""


def _cycle_inputs(spark, sf):
    la = landing(spark, sf)
    landed = la.select("ts_code", "trade_date").distinct()
    tb = la.where("value > 12").select("ts_code", "trade_date").distinct()
    expected = landed.groupBy(F.col("trade_date").alias("date_key")).agg(F.count(F.lit(1)).alias("expected"))
    empty = spark.createDataFrame([], "source_name string, date_key string, period_stock_count bigint, resolved_count bigint")
    return empty, expected, tb, landed


@query(
    "c10_completeness_cycle",
    with_views(
        "landing",
        _CYCLE_SQL
        + """SELECT 'events' AS source_name, date_key, expected AS period_stock_count,
          CASE WHEN n::DOUBLE / expected < 0.92 THEN expected ELSE n END AS resolved_count FROM b""",
    ),
)
def _(spark, sf):
    empty, expected, tb, landed = _cycle_inputs(spark, sf)
    return completeness_jobs.completeness_cycle(empty, "events", expected, tb, landed, ["ts_code", "trade_date"], "trade_date", 0.92)


@query(
    "c19_gap_keys",
    with_views("landing", _CYCLE_SQL + "SELECT date_key FROM b WHERE n::DOUBLE / expected < 0.92 AND date_key BETWEEN '20240105' AND '20240125'"),
)
def _(spark, sf):
    empty, expected, tb, _landed = _cycle_inputs(spark, sf)
    actual = completeness.count_by_key(tb, "trade_date")
    return completeness_jobs.gap_keys(empty, "events", expected, actual, "20240105", "20240125", 0.92)


# A load of the landing's other two thirds into a table that holds the first, with some keys deleted.
_UPKEEP_SQL = """& st AS (SELECT ts_code, trade_date, max(value) AS v FROM landing WHERE ordinal % 3 = 0 GROUP BY 1, 2),
  inc AS (SELECT ts_code, trade_date, max(value) AS v FROM landing WHERE ordinal % 3 <> 0 GROUP BY 1, 2),
  fin AS (SELECT * FROM inc UNION ALL SELECT * FROM st ANTI JOIN inc USING (ts_code, trade_date) WHERE CAST(floor(v * 100) AS BIGINT) % 7 <> 1),
  ex AS (SELECT trade_date AS date_key, count(DISTINCT ts_code) AS n FROM landing GROUP BY 1),
  act AS (SELECT trade_date AS date_key, count(*) AS n, count(*) FILTER (v > 12) AS large FROM fin GROUP BY 1)
"""


def _upkeep(spark, sf):
    la = landing(spark, sf)
    held = lambda rows: rows.groupBy("ts_code", "trade_date").agg(F.max("value").alias("v"))
    keys = ["ts_code", "trade_date"]
    stored, incoming = held(la.where("ordinal % 3 = 0")), held(la.where("ordinal % 3 <> 0"))
    deleted = stored.where(F.floor(F.col("v") * 100) % 7 == 1)
    due = la.groupBy(F.col("trade_date").alias("date_key")).agg(F.countDistinct("ts_code").alias("expected"))
    market = upkeep.Market(listing(spark, sf), calendar(spark, sf), spark.range(0).select(F.lit("").alias("end_date")), suspend(spark, sf))
    sources = [
        upkeep.Source("rows", "trade_date", "custom", custom=lambda _listing, _keys: due),
        upkeep.Source("large", "trade_date", "custom", custom=lambda _listing, _keys: due, counts=F.col("v") > 12),
    ]
    span = ("00000000", "99999999")
    count = lambda table: reduce(DataFrame.unionByName, [upkeep.recounted(s, table, market, *span) for s in sources])
    classified = merge.classify(incoming, stored, keys)
    changes = upkeep.count_changes(upkeep.signed_changes(classified, stored, keys, deleted), sources)
    after = merge.upsert(merge.join_keys(stored, deleted, keys, "left_anti"), incoming, keys)
    return upkeep.kept_up(count(stored), changes, upkeep.all_expected(sources, market, *span)), count(after)


@query(
    "c20_snapshot_upkeep",
    with_views(
        "landing",
        _UPKEEP_SQL
        + """SELECT 'rows' AS source_name, date_key, ex.n AS period_stock_count, coalesce(act.n, 0) AS resolved_count, coalesce(act.n, 0) AS recounted
          FROM ex LEFT JOIN act USING (date_key)
        UNION ALL SELECT 'large', date_key, ex.n, coalesce(large, 0), coalesce(large, 0) FROM ex LEFT JOIN act USING (date_key)""",
    ),
)
def _(spark, sf):
    kept, counted = _upkeep(spark, sf)
    again = counted.select("source_name", "date_key", F.col("resolved_count").alias("recounted"))
    return kept.join(again, upkeep.KEYS, "full")


@query(
    "c11_bar_check",
    with_views(
        "listing calendar suspend bars_d",
        _GRID_SQL
        + """, o AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n FROM opens),
        m AS (SELECT g.ts_code, g.trade_date, o.n FROM grid g JOIN o USING (trade_date) ANTI JOIN bars_d b ON g.ts_code = b.ts_code AND g.trade_date = b.trade_date),
        isl AS (SELECT *, n - row_number() OVER (PARTITION BY ts_code ORDER BY n) AS island FROM m)
        SELECT ts_code, min(trade_date) AS gap_start, max(trade_date) AS gap_end, count(*) AS n_days FROM isl GROUP BY ts_code, island""",
    ),
)
def _(spark, sf):
    m = market(spark, sf, bars=True)
    return completeness_jobs.bar_check(m.listing, m.calendar, universe.full_day_suspended(m.suspend), m.bars)


@query(
    "c11b_bar_check_registry",
    with_views(
        "listing calendar suspend bars_d",
        _GRID_SQL
        + f""", {LOG_SQL}, m AS (SELECT g.* FROM grid g ANTI JOIN bars_d b ON g.ts_code = b.ts_code AND g.trade_date = b.trade_date)
        SELECT coalesce(l.ts_code, m.ts_code) AS ts_code, coalesce(l.missing_date, m.trade_date) AS missing_date,
          CAST(CASE WHEN m.ts_code IS NOT NULL THEN coalesce(l.try_count, 0) + 1 ELSE l.try_count END AS INTEGER) AS try_count
        FROM log l FULL JOIN m ON l.ts_code = m.ts_code AND l.missing_date = m.trade_date
        WHERE NOT EXISTS (SELECT 1 FROM bars_d b WHERE b.ts_code = coalesce(l.ts_code, m.ts_code) AND b.trade_date = coalesce(l.missing_date, m.trade_date))""",
    ),
)
def _(spark, sf):
    m = market(spark, sf, bars=True)
    out = completeness_jobs.bar_check_registry(
        missing_log(spark, sf), m.listing, m.calendar, universe.full_day_suspended(m.suspend), m.bars, None, None,
        F.lit("2024-02-01").cast("timestamp_ntz"),
    )
    return out.select("ts_code", "missing_date", "try_count")


_REPORT_CHECK = f"""& {PERIODS_SQL},
  miss AS (SELECT c.ts_code, per.end_date, c.delist_date FROM companies c JOIN per ON per.end_date >= greatest('19900101', coalesce(c.list_date, ''))
     WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.ts_code = c.ts_code AND r.end_date = per.end_date))
"""


@query(
    "c12_report_check",
    with_views("reports companies", _REPORT_CHECK + "SELECT ts_code, min(end_date) AS first_missing, max(end_date) AS last_missing, count(*) AS n_missing FROM miss GROUP BY 1"),
)
def _(spark, sf):
    return completeness_jobs.report_check_spans(companies(spark, sf), due_periods(spark, sf), reports(spark, sf), "19900101")


@query(
    "c18_report_check_summary",
    with_views(
        "reports companies",
        _REPORT_CHECK
        + """, alive AS (SELECT ts_code FROM companies WHERE coalesce(delist_date, '') = ''),
        n AS (SELECT a.ts_code, count(m.end_date) AS n FROM alive a LEFT JOIN miss m USING (ts_code) GROUP BY 1)
        SELECT count(*) FILTER (n = 0) AS passed, count(*) FILTER (n > 0) AS failed, CAST(sum(n) AS BIGINT) AS missing FROM n""",
    ),
)
def _(spark, sf):
    return completeness_jobs.report_check_summary(companies(spark, sf), due_periods(spark, sf), reports(spark, sf), "19900101")


# ── loads ────────────────────────────────────────────────────────────────


# The final announcement orders the versions otherwise than the first one does.
F_ANN_SQL = "strftime(strptime(end_date, '%Y%m%d') + to_days(CAST(ordinal * 7 % 83 AS INTEGER)), '%Y%m%d')"


@query(
    "c13_report_load",
    with_views(
        "reports companies",
        f"""& li AS (SELECT r.*, {F_ANN_SQL} AS f_ann_date FROM reports r JOIN companies l ON l.ts_code = r.ts_code AND {LISTED_SQL.format(l='l', d='r.end_date')}),
        pk AS (SELECT *, {DOC_SQL} AS income_table FROM li
           QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY (update_flag = '1') DESC, f_ann_date DESC, ordinal) = 1)
        SELECT ts_code, end_date, f_ann_date, 'merge_now' AS report_type, total_revenue, income_table,
          CASE WHEN CAST(floor(total_revenue) AS BIGINT) % 5 = 0 THEN 'insert' WHEN CAST(floor(total_revenue) AS BIGINT) % 3 = 0 THEN 'update' ELSE 'skip' END AS diff_class FROM pk""",
    ),
)
def _(spark, sf):
    model = ["ts_code", "end_date", "report_type", "ann_date", "f_ann_date", "update_flag", "total_revenue"]
    final = F.date_add(F.to_date("end_date", "yyyyMMdd"), (F.col("ordinal") * 7 % 83).cast("int"))
    landed = landed_reports(spark, sf).withColumns({"report_type": F.lit("1"), "f_ann_date": F.date_format(final, "yyyyMMdd")})
    # What is stored is made by a window of its own, not by the operator under test.
    order = [(F.col("update_flag") == "1").desc(), F.desc("f_ann_date"), F.asc("ordinal")]
    first = F.row_number().over(Window.partitionBy("ts_code", "end_date").orderBy(*order))
    stored = landed.withColumn("_i", first).where("_i = 1").drop("_i", "ordinal").withColumn("report_type", F.lit("merge_now"))
    stored = nested.pack_overflow(stored, model, "income_table")
    k = F.col("total_revenue").cast("long")
    stored = stored.where(k % 5 != 0).withColumn("total_revenue", F.when(k % 3 == 0, F.lit(0.0)).otherwise(F.col("total_revenue")))
    out = loads.load_reports(landed, stored, companies(spark, sf), model, "income_table")
    return out.select("ts_code", "end_date", "f_ann_date", "report_type", "total_revenue", "income_table", "diff_class")


_STORED_REPORTS_SQL = f"""& li AS (SELECT r.*, {F_ANN_SQL} AS f_ann_date FROM reports r JOIN companies l ON l.ts_code = r.ts_code AND {LISTED_SQL.format(l='l', d='r.end_date')}),
  pk1 AS (SELECT *, {DOC_SQL} AS income_table FROM li WHERE ordinal % 2 = 0
     QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY (update_flag = '1') DESC, f_ann_date DESC, ordinal) = 1),
  pk2 AS (SELECT *, {DOC_SQL} AS income_table FROM li
     QUALIFY row_number() OVER (PARTITION BY ts_code, end_date ORDER BY (update_flag = '1') DESC, f_ann_date DESC, ordinal) = 1),
  st AS (SELECT * FROM pk2 UNION ALL SELECT * FROM pk1 ANTI JOIN pk2 USING (ts_code, end_date, f_ann_date, update_flag))
"""


@query(
    "c13b_report_store",
    with_views(
        "reports companies",
        _STORED_REPORTS_SQL
        + """SELECT ts_code, end_date, ann_date, f_ann_date, 'merge_now' AS report_type, update_flag, total_revenue, income_table,
          substr(end_date, 1, 6) AS dt, CAST(0 AS BIGINT) AS changed_again FROM st""",
    ),
)
def _(spark, sf):
    """The stored table after a load of half of the versions, one of all, and the same again, which changes nothing."""
    final = F.date_add(F.to_date("end_date", "yyyyMMdd"), (F.col("ordinal") * 7 % 83).cast("int"))
    landed = landed_reports(spark, sf).withColumns({"report_type": F.lit("1"), "f_ann_date": F.date_format(final, "yyyyMMdd")})
    path, known = scratch_path(spark, "report_income"), companies(spark, sf)
    for rows in (landed.where("ordinal % 2 = 0"), landed):
        loads.load_reports_into(path, rows, known, REPORT_INCOME, "income_table")
    again = loads.load_reports_into(path, landed, known, REPORT_INCOME, "income_table")
    changed = F.coalesce(again.where("diff_class != 'skip'").agg(F.sum("n_rows")).scalar(), F.lit(0))
    return loads.read_stored(spark, path, REPORT_INCOME).withColumn("changed_again", changed)


CLOSES = Contract("closes", ("ts_code", "trade_date"), "ts_code string, trade_date string, close double, vol double")


@query(
    "c14c_load_into",
    with_views(
        "bars_d listing",
        f"""& li AS (SELECT b.ts_code, b.trade_date, b.close, b.vol FROM bars_d b JOIN listing l ON l.ts_code = b.ts_code AND {LISTED_SQL.format(l='l', d='b.trade_date')}),
        st AS (SELECT ts_code, trade_date, CASE WHEN CAST(vol AS BIGINT) % 5 = 0 THEN close + 1 ELSE close END AS close, vol
               FROM bars_d WHERE CAST(vol AS BIGINT) % 7 <> 0),
        t AS (SELECT coalesce(li.ts_code, st.ts_code) AS ts_code, coalesce(li.trade_date, st.trade_date) AS trade_date,
                coalesce(li.close, st.close) AS close, coalesce(li.vol, st.vol) AS vol
              FROM st FULL JOIN li ON st.ts_code = li.ts_code AND st.trade_date = li.trade_date)
        SELECT ts_code, trade_date, close, vol, substr(trade_date, 1, 6) AS dt, CAST(0 AS BIGINT) AS changed_again,
          (SELECT count(*) FROM li WHERE CAST(vol AS BIGINT) % 7 = 0) AS inserted FROM t""",
    ),
)
def _(spark, sf):
    b = stage(bars_d(spark, sf).select("ts_code", "trade_date", "close", "vol"))
    v = F.col("vol").cast("long")
    path = scratch_path(spark, "closes")
    loads.load_into(path, b.where(v % 7 != 0).withColumn("close", F.when(v % 5 == 0, F.col("close") + 1).otherwise(F.col("close"))), CLOSES)
    landed = universe.keep_listed(b, stage(listing(spark, sf)), "trade_date")
    first, again = loads.load_into(path, landed, CLOSES), loads.load_into(path, landed, CLOSES)
    n = lambda d, where: F.coalesce(d.where(where).agg(F.sum("n_rows")).scalar(), F.lit(0))
    return loads.read_stored(spark, path, CLOSES).withColumns(
        {"changed_again": n(again, "diff_class != 'skip'"), "inserted": n(first, "diff_class = 'insert'")}
    )


@query(
    "c14d_load_columns",
    with_views(
        "bars_d",
        """SELECT ts_code, trade_date, CASE WHEN CAST(vol AS BIGINT) % 7 <> 0 THEN close END AS close, CASE WHEN CAST(vol AS BIGINT) % 3 = 0 THEN vol + 1 WHEN CAST(vol AS BIGINT) % 7 <> 0 THEN vol END AS vol,
          substr(trade_date, 1, 6) AS dt FROM bars_d WHERE CAST(vol AS BIGINT) % 7 <> 0 OR CAST(vol AS BIGINT) % 3 = 0""",
    ),
)
def _(spark, sf):
    """A load of one column: closes that are stored stay, new rows have none."""
    b = bars_d(spark, sf).select("ts_code", "trade_date", "close", "vol")
    v, path = F.col("vol").cast("long"), scratch_path(spark, "closes")
    loads.load_into(path, b.where(v % 7 != 0), CLOSES)
    loads.load_into(path, b.where(v % 3 == 0).select("ts_code", "trade_date", (F.col("vol") + 1).alias("vol")), CLOSES, ["vol"])
    return loads.read_stored(spark, path, CLOSES)


@query(
    "c14_bar_load",
    with_views(
        "bars_d listing",
        f"""& li AS (SELECT b.ts_code, b.trade_date, b.close, b.vol FROM bars_d b JOIN listing l ON l.ts_code = b.ts_code AND {LISTED_SQL.format(l='l', d='b.trade_date')})
        SELECT ts_code, trade_date, CASE WHEN CAST(vol AS BIGINT) % 7 = 0 THEN 'insert' WHEN CAST(vol AS BIGINT) % 5 = 0 THEN 'update' ELSE 'skip' END AS diff_class FROM li""",
    ),
)
def _(spark, sf):
    b = bars_d(spark, sf).select("ts_code", "trade_date", "close", "vol")
    v = F.col("vol").cast("long")
    stored = b.where(v % 7 != 0).withColumn("close", F.when(v % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return loads.load_bars(b, stored, listing(spark, sf)).select("ts_code", "trade_date", "diff_class")


@query(
    "c14b_satellite_load",
    with_views(
        "bars_m listing",
        f"""& li AS (SELECT b.ts_code, b.trade_date, b.vol AS adj FROM bars_m b JOIN listing l ON l.ts_code = b.ts_code AND {LISTED_SQL.format(l='l', d='b.trade_date')}
              WHERE CAST(b.vol AS BIGINT) % 2 = 0),
        st AS (SELECT ts_code, trade_date, close, adj_factor FROM bars_m WHERE CAST(vol AS BIGINT) % 3 <> 0)
        SELECT coalesce(st.ts_code, li.ts_code) AS ts_code, coalesce(st.trade_date, li.trade_date) AS trade_date, st.close,
          coalesce(li.adj, st.adj_factor) AS adj_factor FROM st FULL JOIN li ON st.ts_code = li.ts_code AND st.trade_date = li.trade_date""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf)
    v = F.col("vol").cast("long")
    landed = b.where(v % 2 == 0).select("ts_code", "trade_date", F.col("vol").alias("adj_factor"))
    stored = b.where(v % 3 != 0).select("ts_code", "trade_date", "close", "adj_factor")
    return loads.load_satellite(landed, stored, listing(spark, sf), ["adj_factor"])


@query(
    "c15_factor_metadata",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """, cov AS (SELECT factor_name, min(trade_date) AS start_date, max(trade_date) AS end_date, count(DISTINCT substr(trade_date, 1, 6)) AS month_count FROM factors GROUP BY 1)
        SELECT m.factor_name, m.formula, c.start_date, c.end_date, coalesce(c.month_count, 0) AS month_count
        FROM (VALUES ('mom3', 'edited'), ('spread', 'high/low-1'), ('unbuilt', 'x')) m(factor_name, formula) LEFT JOIN cov c USING (factor_name)
        UNION ALL SELECT 'old', 'kept', '19900101', '19991231', CAST(1 AS BIGINT)""",
    ),
)
def _(spark, sf):
    stored = spark.createDataFrame(
        [("mom3", "edited", None, None, 0), ("old", "kept", "19900101", "19991231", 1), ("spread", "", None, None, 0)],
        "factor_name string, formula string, start_date string, end_date string, month_count bigint",
    )
    registered = spark.createDataFrame(
        [("mom3", "close/delay(close,3)-1"), ("spread", "high/low-1"), ("unbuilt", "x")], "factor_name string, formula string"
    )
    return factors.refresh_meta(stored, registered, profile.factor_coverage(factors_long(spark, sf)))


_CATALOGUE_NAME = "CASE p_partkey WHEN 0 THEN 'volume' WHEN 1 THEN 'close' WHEN 2 THEN 'mom3' ELSE 'alpha' || p_partkey END"
_META_SQL = (
    FACTORS_SQL[1:]
    + f""", {VENDOR_SQL}, cov AS (SELECT factor_name, min(trade_date) AS start_date, max(trade_date) AS end_date, count(DISTINCT substr(trade_date, 1, 6)) AS month_count
        FROM (SELECT factor_name, trade_date FROM factors UNION ALL SELECT factor_name, trade_date FROM vendor WHERE value IS NOT NULL) GROUP BY 1),
      cat AS (SELECT {_CATALOGUE_NAME} AS factor_name, p_partkey AS n, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END AS body, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS why FROM part),
      stored AS (SELECT {_CATALOGUE_NAME} AS factor_name, CASE WHEN p_partkey % 8 = 0 THEN 'edited ' || p_brand END AS formula FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT 'old' || p_partkey, p_brand FROM part WHERE p_partkey % 50 = 0),
      named AS (
        SELECT * FROM (VALUES ('mom3', 'momentum of 3', '自研', '技术', '{{''window'': 3, ''adj_convention'': ''hfq''}}', 'python', NULL),
          ('momentum_20', 'momentum_20', '自研', '技术', '{{''adj_convention'': ''hfq''}}', 'python', 'barloom/plans/factors.py'),
          ('close', 'Close', 'vendor', '技术', 'close_hfq｜adjusted close', 'vendor', NULL), ('down_streak', 'down_streak', 'vendor', '统计', 'downdays｜downdays', 'vendor', NULL),
          ('ma_5', 'mean', 'vendor', '技术', 'ma_hfq_5｜mean', 'vendor', NULL)) v(factor_name, display_name, source, category, formula, impl_kind, python_path)
        UNION ALL SELECT c.factor_name, 'Alpha' || n, 'catalogue', 'catalogue',
          coalesce(s.formula, CASE WHEN why = '' THEN body WHEN body = '' THEN why ELSE body || '｜[' || why || ']' END), 'formula', NULL
        FROM cat c LEFT JOIN stored s USING (factor_name) WHERE c.factor_name NOT IN ('mom3', 'close')),
      meta AS (SELECT n.*, c.start_date, c.end_date, coalesce(c.month_count, 0) AS month_count FROM named n LEFT JOIN cov c USING (factor_name)
        UNION ALL SELECT factor_name, factor_name, 'kept', NULL, formula, NULL, NULL, '19900101', '19991231', 1 FROM stored WHERE factor_name NOT IN (SELECT factor_name FROM named))
"""
)


def _factor_meta(spark, sf):
    """Metadata after a refresh of two registered factors, a vendor's frame and a catalogue of as many formulas as parts."""

    class Momentum3:
        def meta(self):
            return factors.FactorMeta("mom3", 3, display_name="momentum of 3", params=(("window", 3),))

    part = table(spark, sf, "part").withColumn("factor_name", F.expr(_CATALOGUE_NAME))
    none = F.lit(None).cast("string")
    edited = part.where("p_partkey % 4 = 0").select("factor_name", F.expr("CASE WHEN p_partkey % 8 = 0 THEN 'edited ' || p_brand END").alias("formula"))
    old = part.where("p_partkey % 50 = 0").select(F.expr("'old' || p_partkey").alias("factor_name"), F.col("p_brand").alias("formula"))
    stored = edited.unionByName(old).select(
        "factor_name",
        F.col("factor_name").alias("display_name"),
        F.lit("kept").alias("source"),
        none.alias("category"),
        "formula",
        none.alias("impl_kind"),
        none.alias("python_path"),
        F.lit("19900101").alias("start_date"),
        F.lit("19991231").alias("end_date"),
        F.lit(1).cast("long").alias("month_count"),
    )
    formulas = part.select(
        "factor_name",
        F.col("p_partkey").alias("number"),
        F.expr("CASE WHEN p_size % 7 = 0 THEN '' ELSE p_name END").alias("formula"),
        F.expr("CASE WHEN p_size % 3 = 0 THEN p_type END").alias("skip_reason"),
    )
    wide = vendor_wide(spark, sf)
    entries = factor_meta.first_named(
        factor_meta.from_registered(spark, [Momentum3(), factors.Momentum(20)]).withColumn(
            "python_path", F.when(F.col("factor_name") == "mom3", none).otherwise(F.col("python_path"))
        ),
        factor_meta.from_vendor(wide, {"close_hfq": "Close -adjusted close", "ma_hfq_5": "mean"}),
        factor_meta.from_catalogue(formulas, stored),
    )
    values = factors_long(spark, sf).select("factor_name", "trade_date").unionByName(sinks.vendor_long(wide).where("value IS NOT NULL").select("factor_name", "trade_date"))
    return factor_meta.refreshed(stored, entries, profile.factor_coverage(values))


@query("c15b_factor_meta_sources", with_views("bars_m", "&" + _META_SQL + "SELECT * FROM meta"))
def _(spark, sf):
    return _factor_meta(spark, sf)


@query("c15c_factor_meta_by_source", with_views("bars_m", "&" + _META_SQL + "SELECT source, count(*) AS n_factors, count(start_date) AS n_with_data FROM meta GROUP BY 1"))
def _(spark, sf):
    return factor_meta.by_source(_factor_meta(spark, sf))


@query(
    "c17_vendor_batch",
    with_views(
        "bars_m",
        f"& {VENDOR_SQL} SELECT factor_name, ts_code, trade_date, value, substr(trade_date, 1, 6) AS dt FROM vendor WHERE substr(trade_date, 5, 2) NOT IN ('03', '04') OR substr(trade_date, 1, 6) = '200103'",
    ),
)
def _(spark, sf):
    w = vendor_wide(spark, sf)
    opens = w.select("trade_date").distinct()
    have = opens.where(F.substring("trade_date", 5, 2).isin("03", "04"))
    days = factors.wide_days_to_load(opens, have, "200103")
    root = scratch_path(spark, "warehouse")
    sinks.write_factors(sinks.vendor_long(w.join(days, "trade_date", "left_semi")), root)
    return B.FactorStore(spark, root).table().select("factor_name", "ts_code", "trade_date", "value", "dt")


# ── plug-ins ─────────────────────────────────────────────────────────────


@query(
    "x1_factor_plugin",
    with_views("bars_m", "SELECT ts_code, trade_date, round(high * coalesce(adj_factor, 1.0) / (low * coalesce(adj_factor, 1.0)) - 1.0::DOUBLE, 8) AS value FROM bars_m"),
)
def _(spark, sf):
    class Spread:
        def meta(self):
            return factors.FactorMeta("spread", 0)

        def compute(self, bars):
            return bars.select("ts_code", "trade_date", (F.col("high_adj") / F.col("low_adj") - 1.0).alias("value"))

    plug: factors.Factor = Spread()
    return plug.compute(B.with_adjusted(bars_m(spark, sf))).withColumn("value", F.round("value", 8))


@query(
    "x3_per_code_function",
    with_views(
        "bars_m",
        """& p AS (SELECT ts_code, trade_date, vol - 250 AS v FROM bars_m)
        SELECT ts_code, trade_date, max(cs) OVER (PARTITION BY ts_code ORDER BY trade_date) AS value FROM
          (SELECT *, sum(v) OVER (PARTITION BY ts_code ORDER BY trade_date) AS cs FROM p)""",
    ),
)
def _(spark, sf):
    def highest_sum(v):
        import numpy as np

        return np.maximum.accumulate(np.cumsum(v))

    p = bars_m(spark, sf).select("ts_code", "trade_date", (F.col("vol") - 250).alias("v"))
    return apply_per_code(p, ["v"], highest_sum, "value")


@query(
    "x4_alpha_text",
    with_views(
        "bars_m",
        ADJ_SQL + "SELECT ts_code, trade_date, 'text_range' AS factor_name, round((h - l) / c + abs(o - c) / c, 6) AS value FROM adj",
    ),
)
def _(spark, sf):
    a = alphas.from_text("text_range", "(high_adj - low_adj) / close_adj + abs(open_adj - close_adj) / close_adj")
    return alphas.compute(panel.build(bars_m(spark, sf)), [a]).withColumn("value", F.round("value", 6))


@query(
    "x7_strategy_plugin",
    with_views(
        _VIEWS,
        _SINGLE.replace(
            "grp AS (SELECT *, ntile(3) OVER (PARTITION BY trade_date ORDER BY value DESC, ts_code) - 1 AS g FROM inv)",
            "grp AS (SELECT *, 0 AS g FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY value DESC, ts_code) AS rn FROM inv) WHERE rn <= 5)",
        )
        + "SELECT trade_date, group_id, ts_code, round(weight, 6) AS weight FROM held",
    ),
)
def _(spark, sf):
    class TopFive(backtest.SingleFactor):
        """The five best codes, equally weighted."""

        def weights(self, scored):
            best = ordering.positions(scored, ["trade_date"], [-F.col("value"), F.col("ts_code")]).where("position <= 5")
            sized = ordering.with_group_stats(best, ["trade_date"], {"_n": F.count(F.lit(1))})
            return sized.select("ts_code", "trade_date", F.lit("G0").alias("group_id"), (1.0 / F.col("_n")).alias("weight"))

    return _r(run_backtest(spark, sf, TopFive("mom5", 1)).portfolio)
