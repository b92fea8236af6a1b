"""J: joins of the panel, the listing, the calendar and the load."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.predicates import FULL_DAY_SQL
from barloom.catalog.registry import query
from barloom.catalog.rolling import panel
from barloom.catalog.views import (
    bars_d,
    bars_m,
    calendar,
    companies,
    index_m,
    landing,
    listing,
    market,
    report_quarters,
    reports,
    suspend,
    table,
    with_views,
    ymd,
)
from barloom.operators import factorset, gaps, merge, ordering, portfolio, series, spine, universe
from barloom.session import stage

LISTED_SQL = (
    "({l}.list_date IS NOT NULL AND {l}.list_date <> '' AND {l}.list_date <= {d} "
    "AND ({l}.delist_date IS NULL OR {l}.delist_date = '' OR {l}.delist_date > {d}))"
)

# ── panel joins ──────────────────────────────────────────────────────────


@query(
    "j1_benchmark",
    with_views(
        "bars_m index_m",
        """SELECT b.ts_code, b.trade_date, b.close, i.open AS benchmark_open, i.close AS benchmark_close
        FROM bars_m b LEFT JOIN (SELECT * FROM index_m WHERE ts_code = '000300.SH') i ON b.trade_date = i.trade_date""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf).select("ts_code", "trade_date", "close")
    return factorset.attach_benchmark(b, index_m(spark, sf), "000300.SH")


FACTORS_SQL = """, wide AS (SELECT ts_code, trade_date,
     close * adj_factor / lag(close * adj_factor, 3) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1.0::DOUBLE AS mom3,
     CASE WHEN CAST(vol AS BIGINT) % 3 <> 0 THEN vol END AS volume, high / low - 1.0::DOUBLE AS spread FROM bars_m),
  factors AS (SELECT ts_code, trade_date, 'mom3' AS factor_name, mom3 AS value FROM wide WHERE mom3 IS NOT NULL
     UNION ALL SELECT ts_code, trade_date, 'volume', volume FROM wide WHERE volume IS NOT NULL
     UNION ALL SELECT ts_code, trade_date, 'spread', spread FROM wide WHERE spread IS NOT NULL)
"""


def factors_long(spark, sf):
    from barloom.functions.rolling import momentum

    x = F.col("close") * F.col("adj_factor")
    w = bars_m(spark, sf).select(
        "ts_code",
        "trade_date",
        momentum(x, 3).alias("mom3"),
        F.when(F.col("vol").cast("long") % 3 != 0, F.col("vol")).alias("volume"),
        (F.col("high") / F.col("low") - 1.0).alias("spread"),
    )
    return factorset.long(w, ["mom3", "volume", "spread"])


@query(
    "j2_factor_cross_section",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """SELECT w.ts_code, w.trade_date, round(mom3, 8) AS mom3, volume, round(spread, 8) AS spread,
          CAST(NULL AS DOUBLE) AS absent FROM wide w WHERE mom3 IS NOT NULL""",
    ),
)
def _(spark, sf):
    w = factorset.cross_section(factors_long(spark, sf), ["mom3", "volume", "spread", "absent"])
    return w.select("ts_code", "trade_date", F.round("mom3", 8).alias("mom3"), "volume", F.round("spread", 8).alias("spread"), "absent")


@query(
    "j3_factor_merge",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """SELECT coalesce(a.ts_code, b.ts_code) AS ts_code, coalesce(a.trade_date, b.trade_date) AS trade_date,
            round(a.value, 8) AS mom3, b.value AS volume
        FROM (SELECT * FROM factors WHERE factor_name = 'mom3') a
        FULL JOIN (SELECT * FROM factors WHERE factor_name = 'volume') b
          ON a.ts_code = b.ts_code AND a.trade_date = b.trade_date""",
    ),
)
def _(spark, sf):
    w = factorset.wide(factors_long(spark, sf), ["mom3", "volume"])
    return w.select("ts_code", "trade_date", F.round("mom3", 8).alias("mom3"), "volume")


# ── calendar and listing ─────────────────────────────────────────────────


@query(
    "j4_nearest_open",
    with_views(
        "calendar",
        """& o AS (SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 20, '%Y%m%d') AS day FROM orders)
        SELECT o.o_orderkey, o.day, c.cal_date AS open_date FROM o ASOF LEFT JOIN
          (SELECT cal_date FROM calendar WHERE is_open = '1') c ON o.day >= c.cal_date""",
    ),
)
def _(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey", ymd(F.date_sub(F.to_date("o_orderdate"), 20)).alias("day"))
    return spine.nearest_open(keys, "day", spine.open_dates(calendar(spark, sf)))


@query(
    "j5_listed_on_date",
    with_views(
        "listing calendar",
        f"""& d AS (SELECT max(cal_date) AS trade_date FROM calendar WHERE is_open = '1' GROUP BY substr(cal_date, 1, 6))
        SELECT d.trade_date, l.ts_code FROM d JOIN listing l ON {LISTED_SQL.format(l='l', d='d.trade_date')}""",
    ),
)
def _(spark, sf):
    days = spine.last_of_period(spine.open_dates(calendar(spark, sf)), "monthly").select("trade_date")
    known = listing(spark, sf).where(F.coalesce(F.col("list_date"), F.lit("")) != "")
    return gaps.expected_grid(known, days).select("trade_date", "ts_code")


@query(
    "j6_listed_bars",
    with_views(
        "bars_d listing",
        f"""SELECT b.ts_code, b.trade_date, b.close FROM bars_d b
        WHERE EXISTS (SELECT 1 FROM listing l WHERE l.ts_code = b.ts_code AND {LISTED_SQL.format(l='l', d='b.trade_date')})""",
    ),
)
def _(spark, sf):
    return universe.keep_listed(bars_d(spark, sf), listing(spark, sf), "trade_date").select("ts_code", "trade_date", "close")


@query(
    "j6b_listed_reports",
    with_views(
        "reports companies",
        f"""SELECT r.ts_code, r.end_date, r.ordinal FROM reports r
        WHERE EXISTS (SELECT 1 FROM companies l WHERE l.ts_code = r.ts_code AND {LISTED_SQL.format(l='l', d='r.end_date')})""",
    ),
)
def _(spark, sf):
    return universe.keep_listed(reports(spark, sf), companies(spark, sf), "end_date").select("ts_code", "end_date", "ordinal")


@query(
    "j7_not_suspended",
    with_views(
        "bars_d suspend",
        f"""SELECT b.ts_code, b.trade_date FROM bars_d b WHERE NOT EXISTS
        (SELECT 1 FROM suspend s WHERE s.ts_code = b.ts_code AND s.trade_date = b.trade_date AND {FULL_DAY_SQL})""",
    ),
)
def _(spark, sf):
    b = bars_d(spark, sf).select("ts_code", "trade_date")
    return b.join(universe.full_day_suspended(suspend(spark, sf)), ["ts_code", "trade_date"], "left_anti")


_GRID_SQL = f"""& opens AS (SELECT cal_date AS trade_date FROM calendar WHERE is_open = '1'),
  grid AS (SELECT l.ts_code, o.trade_date FROM listing l JOIN opens o
     ON coalesce(l.list_date, '') <= o.trade_date AND (coalesce(l.delist_date, '') = '' OR l.delist_date > o.trade_date)
     WHERE NOT EXISTS (SELECT 1 FROM suspend s WHERE s.ts_code = l.ts_code AND s.trade_date = o.trade_date AND {FULL_DAY_SQL}))
"""


def _grid(spark, sf):
    m = market(spark, sf)
    return gaps.expected_grid(m.listing, spine.open_dates(m.calendar), suspended=universe.full_day_suspended(m.suspend))


@query("j9_expected_grid", with_views("listing calendar suspend", _GRID_SQL + "SELECT * FROM grid"))
def _(spark, sf):
    return _grid(spark, sf)


@query(
    "j9b_expected_days_of_code",
    with_views("listing calendar suspend", _GRID_SQL + "SELECT * FROM grid WHERE ts_code LIKE '%000000000012.SH'"),
)
def _(spark, sf):
    m = market(spark, sf)
    one = m.listing.where(F.col("ts_code").endswith("000000000012.SH"))
    return gaps.expected_grid(one, spine.open_dates(m.calendar), suspended=universe.full_day_suspended(m.suspend))


@query(
    "j8_missing_keys",
    with_views(
        "listing calendar suspend bars_d",
        _GRID_SQL + "SELECT g.* FROM grid g ANTI JOIN bars_d b ON g.ts_code = b.ts_code AND g.trade_date = b.trade_date",
    ),
)
def _(spark, sf):
    m = market(spark, sf, bars=True)
    return gaps.missing_days(m.listing, spine.open_dates(m.calendar), m.bars, suspended=universe.full_day_suspended(m.suspend))


# ── reports ──────────────────────────────────────────────────────────────

PERIOD_MERGE_SQL = f"""& per AS (SELECT end_date, count(*) FILTER (report_type = '1') AS income_count,
     count(*) FILTER (report_type = '2') AS balance_count, count(*) FILTER (report_type = '3') AS cashflow_count,
     count(*) FILTER (report_type = '4') AS indicator_count FROM reports WHERE report_type <> '5' GROUP BY 1),
  lc AS (SELECT p.end_date, count(l.ts_code) AS listed_count FROM per p
     LEFT JOIN companies l ON {LISTED_SQL.format(l='l', d='p.end_date')} GROUP BY 1)
"""


@query("j10_period_merge", with_views("reports companies", PERIOD_MERGE_SQL + "SELECT per.*, listed_count FROM per JOIN lc USING (end_date)"))
def _(spark, sf):
    from barloom.operators.completeness import period_counts, with_listed_count

    q = report_quarters(spark, sf)
    statements = {n: F.col(f"n{t}") for n, t in zip(("income", "balance", "cashflow", "indicator"), "1234")}
    return with_listed_count(period_counts(q, statements), companies(spark, sf, q))


# ── load ─────────────────────────────────────────────────────────────────

_DIFF_SQL = """& old AS (SELECT ts_code, trade_date, CASE WHEN CAST(vol AS BIGINT) % 5 = 0 THEN close * 1.01::DOUBLE
        WHEN CAST(vol AS BIGINT) % 3 = 0 THEN close + 1e-10::DOUBLE ELSE close END AS close, adj_factor
     FROM bars_m WHERE CAST(vol AS BIGINT) % 7 <> 0),
  cls AS (SELECT n.ts_code, n.trade_date,
     CASE WHEN n.trade_date < '19960101' THEN 'skip' WHEN o.ts_code IS NULL THEN 'insert'
          WHEN abs(o.close - n.close) <= 1e-9 AND (o.adj_factor IS NOT DISTINCT FROM n.adj_factor) THEN 'skip'
          ELSE 'update' END AS diff_class
     FROM bars_m n LEFT JOIN old o ON n.ts_code = o.ts_code AND n.trade_date = o.trade_date)
"""


def _diff(spark, sf):
    new = bars_m(spark, sf).select("ts_code", "trade_date", "close", "adj_factor")
    v = F.col("vol").cast("long")
    old = bars_m(spark, sf).where(v % 7 != 0).select(
        "ts_code",
        "trade_date",
        F.when(v % 5 == 0, F.col("close") * 1.01).when(v % 3 == 0, F.col("close") + 1e-10).otherwise(F.col("close")).alias("close"),
        "adj_factor",
    )
    return merge.classify(new, old, ["ts_code", "trade_date"], in_scope=F.col("trade_date") >= "19960101")


@query("j11_row_diff", with_views("bars_m", _DIFF_SQL + "SELECT * FROM cls"))
def _(spark, sf):
    return _diff(spark, sf).select("ts_code", "trade_date", "diff_class")


@query("j11c_row_diff_counts", with_views("bars_m", _DIFF_SQL + "SELECT diff_class, count(*) AS n_rows FROM cls GROUP BY 1"))
def _(spark, sf):
    return merge.diff_counts(_diff(spark, sf))


@query(
    "j11b_report_diff",
    with_views(
        "reports",
        """SELECT ordinal, CASE WHEN ordinal % 11 = 0 THEN 'insert'
               WHEN ordinal % 7 = 0 OR ordinal % 13 = 0 THEN 'update' ELSE 'skip' END AS diff_class FROM reports""",
    ),
)
def _(spark, sf):
    r = reports(spark, sf)
    k = F.col("ordinal")
    doc = lambda a, b: F.concat(F.lit("{"), a, F.lit(","), b, F.lit("}"))
    kv = lambda n, v: F.concat(F.lit(f'"{n}":'), v.cast("string"))
    new = r.select("ordinal", "ann_date", "total_revenue", doc(kv("a", k), kv("b", F.lit(1))).alias("income_table"))
    old = r.where(k % 11 != 0).select(
        "ordinal",
        F.when(k % 7 == 0, F.lit("19000101")).otherwise(F.col("ann_date")).alias("ann_date"),
        "total_revenue",
        F.when(k % 13 == 0, doc(kv("b", F.lit(2)), kv("a", k))).otherwise(doc(kv("b", F.lit(1)), kv("a", k))).alias("income_table"),
    )
    return merge.classify(new, old, ["ordinal"], json_columns=("income_table",)).select("ordinal", "diff_class")


@query(
    "j11d_nested_report_diff",
    with_views(
        "reports",
        """SELECT ordinal, CASE WHEN ordinal % 11 = 0 THEN 'insert' WHEN ordinal % 5 IN (1, 2) OR ordinal % 7 = 0 THEN 'update' ELSE 'skip' END AS diff_class FROM reports""",
    ),
)
def _(spark, sf):
    """Nested documents: other key order and spacing are no change; a number that became a text, another array order and
    a changed inner value are."""
    k = F.col("ordinal")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = k.cast("string")
    plain = text('{"a":{"x":', n, ',"y":[1,{"p":2.5,"q":null}]},"b":"t"}')
    turned = text('{ "b" : "t", "a": {"y": [1, {"q": null, "p": 2.5}], "x": ', n, "} }")
    as_text = text('{"a":{"x":"', n, '","y":[1,{"p":2.5,"q":null}]},"b":"t"}')
    reversed_ = text('{"a":{"x":', n, ',"y":[{"p":2.5,"q":null},1]},"b":"t"}')
    inner = text('{"a":{"x":', n, ',"y":[1,{"p":2.25,"q":null}]},"b":"t"}')
    old_doc = F.when(k % 7 == 0, inner).when(k % 5 == 1, as_text).when(k % 5 == 2, reversed_).when(k % 5 == 3, turned).otherwise(plain)
    r = reports(spark, sf)
    new = r.select("ordinal", plain.alias("income_table"))
    old = r.where(k % 11 != 0).select("ordinal", old_doc.alias("income_table"))
    return merge.classify(new, old, ["ordinal"], json_columns=("income_table",)).select("ordinal", "diff_class")


@query(
    "j12_reconcile",
    with_views(
        "bars_d calendar",
        """& a AS (SELECT substr(trade_date, 1, 6) AS month, count(*) AS n FROM bars_d WHERE trade_date >= '19950601' GROUP BY 1),
        b AS (SELECT substr(trade_date, 1, 6) AS month, count(*) AS n FROM bars_d
              WHERE substr(trade_date, 5, 2) NOT IN ('03', '11') AND NOT (substr(trade_date, 5, 2) = '07' AND ts_code LIKE '600%')
              GROUP BY 1),
        skips AS (SELECT DISTINCT substr(trade_date, 1, 6) AS month FROM
              (SELECT trade_date, count(*) AS n FROM bars_d GROUP BY 1) WHERE n < 0.99 * 12)
        SELECT coalesce(a.month, b.month) AS month, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n,
          CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'ok'
               WHEN b.n IS NULL THEN CASE WHEN s.month IS NOT NULL THEN 'expected_skip' ELSE 'left_only' END
               WHEN a.n IS NULL THEN 'right_only' ELSE 'diff' END AS status
        FROM a FULL JOIN b ON a.month = b.month LEFT JOIN skips s ON s.month = coalesce(a.month, b.month)""",
    ),
)
def _(spark, sf):
    b = bars_d(spark, sf).select("ts_code", "trade_date", F.substring("trade_date", 1, 6).alias("month"))
    left = b.where(F.col("trade_date") >= "19950601")
    mm = F.substring("trade_date", 5, 2)
    right = b.where(~mm.isin("03", "11") & ~((mm == "07") & F.col("ts_code").startswith("600")))
    per_day = b.groupBy("trade_date", "month").agg(F.count(F.lit(1)).alias("n"))
    skips = per_day.where(F.col("n") < F.lit(0.99) * 12).select("month").distinct()
    return merge.reconcile_counts(left, right, "month", skips)


GROUPS_SQL = """, hold AS (SELECT trade_date, dense_rank() OVER (ORDER BY trade_date) AS no, ts_code, g,
      1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, g) AS w
   FROM (SELECT ts_code, trade_date, ntile(5) OVER (PARTITION BY trade_date ORDER BY x DESC, ts_code) - 1 AS g
         FROM (SELECT ts_code, trade_date, close * adj_factor AS x FROM bars_m) WHERE x IS NOT NULL)),
  trades AS (SELECT coalesce(a.no, b.no + 1) AS rebalance_no, 'G' || coalesce(a.g, b.g) AS group_id,
      coalesce(a.ts_code, b.ts_code) AS ts_code, coalesce(a.w, 0) - coalesce(b.w, 0) AS dw
   FROM hold a FULL JOIN hold b ON a.no = b.no + 1 AND a.g = b.g AND a.ts_code = b.ts_code),
  t AS (SELECT * FROM trades WHERE abs(dw) >= 1e-12)
"""


def holdings(spark, sf):
    from pyspark.sql import Window

    g = stage(portfolio.with_group_id(ordering.quantile_groups(stage(panel(spark, sf)), "x", 5, ["trade_date"])))
    numbered = g.select("trade_date").distinct().withColumn(
        "rebalance_no", F.row_number().over(Window.orderBy("trade_date")).cast("long")
    )
    return g.join(numbered, "trade_date").select("rebalance_no", "group_id", "ts_code", "weight")


@query(
    "j13_holdings_delta",
    with_views(
        "bars_m",
        "&" + GROUPS_SQL[1:]
        + """SELECT rebalance_no, group_id, ts_code, round(dw, 8) AS delta_weight,
          round(abs(dw) * 0.0003::DOUBLE + CASE WHEN dw < 0 THEN abs(dw) * 0.001::DOUBLE ELSE 0 END, 10) AS cost FROM t""",
    ),
)
def _(spark, sf):
    t = portfolio.holdings_delta(holdings(spark, sf))
    return t.select(
        "rebalance_no", "group_id", "ts_code", F.round("delta_weight", 8).alias("delta_weight"), F.round("cost", 10).alias("cost")
    )


@query(
    "j14_factor_forward_return",
    with_views(
        "bars_m",
        """& p AS (SELECT ts_code, trade_date, close * adj_factor AS x, close * coalesce(adj_factor, 1.0) AS c FROM bars_m),
        r AS (SELECT ts_code, trade_date, lead(c) OVER (PARTITION BY ts_code ORDER BY trade_date) / c - 1.0::DOUBLE AS fwd FROM p)
        SELECT p.ts_code, p.trade_date, p.x AS factor, round(r.fwd, 6) AS fwd FROM p JOIN r USING (ts_code, trade_date)
        WHERE p.x IS NOT NULL AND r.fwd IS NOT NULL""",
    ),
)
def _(spark, sf):
    from pyspark.sql import Window

    p = panel(spark, sf)
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    fwd = p.select("ts_code", "trade_date", (F.lead("c").over(w) / F.col("c") - 1.0).alias("fwd"))
    f = p.where(F.col("x").isNotNull()).select("ts_code", "trade_date", F.col("x").alias("factor"))
    j = f.join(fwd.where(F.col("fwd").isNotNull()), ["trade_date", "ts_code"])
    return j.select("ts_code", "trade_date", "factor", F.round("fwd", 6).alias("fwd"))


_SOURCES = ["purchase", "signup", "click", "view", "error"]


@query(
    "j15_source_fallback",
    with_views(
        "landing",
        f"""& r AS (SELECT *, list_position({_SOURCES}, source) AS rk FROM landing),
        best AS (SELECT ts_code, trade_date, min(rk) AS rk FROM r GROUP BY 1, 2)
        SELECT r.ts_code, r.trade_date, r.source, r.ordinal FROM r JOIN best USING (ts_code, trade_date, rk)""",
    ),
)
def _(spark, sf):
    rank = F.array_position(F.array(*[F.lit(s) for s in _SOURCES]), F.col("source"))
    r = landing(spark, sf).withColumn("source_rank", rank)
    return merge.fallback(r, ["ts_code", "trade_date"]).select("ts_code", "trade_date", "source", "ordinal")


# ── NAV ──────────────────────────────────────────────────────────────────

_NAV_SQL = """& closes AS (SELECT trade_date, close FROM index_m WHERE ts_code = '000300.SH' AND substr(trade_date, 5, 2) <> '05'),
  dates AS (SELECT DISTINCT trade_date FROM bars_m WHERE trade_date >= '19960501'),
  f AS (SELECT min(trade_date) AS d0 FROM dates),
  base AS (SELECT coalesce((SELECT max_by(close, trade_date) FROM closes, f WHERE trade_date <= d0),
                           (SELECT min_by(close, trade_date) FROM closes SEMI JOIN dates USING (trade_date))) AS b),
  bm AS (SELECT d.trade_date, coalesce(last_value(c.close IGNORE NULLS) OVER (ORDER BY d.trade_date
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b) / b AS value
        FROM dates d CROSS JOIN base LEFT JOIN closes c USING (trade_date)),
  st AS (SELECT trade_date, product(1.0::DOUBLE + r * 0.01) OVER (ORDER BY trade_date) AS value
        FROM (SELECT trade_date, round(avg(close / open - 1.0::DOUBLE), 8) AS r FROM bars_m GROUP BY 1))
"""


def _navs(spark, sf):
    closes = index_m(spark, sf).where((F.col("ts_code") == "000300.SH") & (F.substring("trade_date", 5, 2) != "05"))
    r = stage(bars_m(spark, sf).groupBy("trade_date").agg((F.round(F.avg(F.col("close") / F.col("open") - 1.0), 8) * 0.01).alias("r")))
    dates = r.where(F.col("trade_date") >= "19960501").select("trade_date")
    return series.nav(r, "r").select("trade_date", F.col("nav").alias("value")), series.benchmark_nav(dates, closes)


@query("j17_benchmark_nav", with_views("bars_m index_m", _NAV_SQL + "SELECT trade_date, round(value, 6) AS value FROM bm"))
def _(spark, sf):
    return _navs(spark, sf)[1].select("trade_date", F.round("value", 6).alias("value"))


@query(
    "j16_excess_nav",
    with_views(
        "bars_m index_m",
        _NAV_SQL + "SELECT trade_date, round(st.value / bm.value, 6) AS value FROM st JOIN bm USING (trade_date) WHERE bm.value <> 0",
    ),
)
def _(spark, sf):
    st, bm = _navs(spark, sf)
    return series.excess_nav(st, bm).select("trade_date", F.round("value", 6).alias("value"))


@query(
    "j18_names",
    with_views(
        "bars_d listing",
        """& g AS (SELECT ts_code, count(*) AS n_bars FROM bars_d GROUP BY 1)
        SELECT g.ts_code, n_bars, name, list_date, delist_date FROM g LEFT JOIN (SELECT * FROM listing WHERE market = '主板') l
        ON g.ts_code = l.ts_code""",
    ),
)
def _(spark, sf):
    g = bars_d(spark, sf).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n_bars"))
    return universe.names_for(g, listing(spark, sf).where(F.col("market") == "主板"))
