"""R, A18-A20 and A26: order and spread inside one date's cross-section."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.rolling import panel as derived_panel
from barloom.catalog.views import bars_m, with_views
from barloom.operators import ordering, portfolio, sliding, xsection
from barloom.session import stage

_X = """& p AS (SELECT ts_code, trade_date, close * adj_factor AS x, vol AS y, close, up_limit, down_limit FROM bars_m)
"""


def panel(spark, sf):
    """The panel, staged: ordering a cross-section reads it several times."""
    return stage(derived_panel(spark, sf))


@query(
    "r1_rank",
    with_views(
        "bars_m",
        _X
        + """, q AS (SELECT *, rank() OVER (PARTITION BY trade_date, y % 40 IS NULL ORDER BY y % 40) AS rk,
                      count(*) OVER (PARTITION BY trade_date, y % 40) AS ties,
                      count(y) OVER (PARTITION BY trade_date) AS n FROM p)
        SELECT ts_code, trade_date, round((rk + (ties - 1) / 2.0::DOUBLE) / n, 6) AS value FROM q""",
    ),
)
def _(spark, sf):
    p = panel(spark, sf).withColumn("v", F.col("y") % 40)
    return ordering.average_rank(p, "v", ["trade_date"], "r", share=True).select(
        "ts_code", "trade_date", F.round("r", 6).alias("value")
    )


@query(
    "r1b_rank_nulls",
    with_views(
        "bars_m",
        _X
        + """, q AS (SELECT ts_code, trade_date, x, rank() OVER (PARTITION BY trade_date ORDER BY x) AS rk,
                      count(*) OVER (PARTITION BY trade_date, x) AS ties,
                      count(*) OVER (PARTITION BY trade_date) AS n FROM p WHERE x IS NOT NULL)
        SELECT p.ts_code, p.trade_date, round((rk + (ties - 1) / 2.0::DOUBLE) / n, 6) AS value
        FROM p LEFT JOIN q ON p.ts_code = q.ts_code AND p.trade_date = q.trade_date""",
    ),
)
def _(spark, sf):
    return ordering.average_rank(panel(spark, sf), "x", ["trade_date"], "r", share=True).select(
        "ts_code", "trade_date", F.round("r", 6).alias("value")
    )


@query(
    "r2_rank_window",
    with_views(
        "bars_m",
        """& p AS (SELECT ts_code, trade_date, vol AS y FROM bars_m),
        l AS (SELECT *, list(y) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ys FROM p)
        SELECT ts_code, trade_date, CASE WHEN len(ys) = 10
          THEN round(CAST(len(list_filter(ys, lambda v: v <= y)) AS DOUBLE) / 10, 6) END AS value FROM l""",
    ),
)
def _(spark, sf):
    ranked = sliding.sliding(derived_panel(spark, sf), [sliding.Sliding("value", "rank", "y", 10)])
    return ranked.select("ts_code", "trade_date", F.round("value", 6).alias("value"))


@query(
    "r3_quantile_groups",
    with_views(
        "bars_m",
        _X
        + """, g AS (SELECT ts_code, trade_date, ntile(7) OVER (PARTITION BY trade_date ORDER BY x DESC, ts_code) - 1 AS g
                FROM p WHERE x IS NOT NULL)
        SELECT ts_code, trade_date, 'G' || g AS group_id,
               round(1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, g), 8) AS weight FROM g""",
    ),
)
def _(spark, sf):
    g = ordering.quantile_groups(panel(spark, sf), "x", 7, ["trade_date"])
    return g.select(
        "ts_code",
        "trade_date",
        F.concat(F.lit("G"), F.col("group_no").cast("string")).alias("group_id"),
        F.round("weight", 8).alias("weight"),
    )


@query(
    "r4_filter_renormalise",
    with_views(
        "bars_m",
        _X
        + """, g AS (SELECT ts_code, trade_date, ntile(5) OVER (PARTITION BY trade_date ORDER BY x DESC, ts_code) - 1 AS g
                FROM p WHERE x IS NOT NULL),
        w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY trade_date, g) AS w FROM g),
        k AS (SELECT w.* FROM w JOIN p USING (ts_code, trade_date)
              WHERE NOT (coalesce(close >= up_limit * 0.999::DOUBLE, false) OR coalesce(close <= down_limit * 1.001::DOUBLE, false)))
        SELECT ts_code, trade_date, 'G' || g AS group_id,
               round(w / sum(abs(w)) OVER (PARTITION BY trade_date, g), 8) AS weight FROM k""",
    ),
)
def _(spark, sf):
    from barloom.functions.scalars import limit_hit

    b = bars_m(spark, sf).withColumn("x", F.col("close") * F.col("adj_factor"))
    b = stage(b).withColumn("blocked", limit_hit(F.col("close"), F.col("up_limit"), F.col("down_limit")))
    targets = portfolio.with_group_id(ordering.quantile_groups(b, "x", 5, ["trade_date"]))
    kept = portfolio.renormalise(targets.where(~F.col("blocked")))
    return kept.select("ts_code", "trade_date", "group_id", F.round("weight", 8).alias("weight"))


@query(
    "r5_ranked_listing",
    with_views(
        "bars_m",
        _X
        + """SELECT trade_date, ts_code, x AS value,
             row_number() OVER (PARTITION BY trade_date ORDER BY x DESC, ts_code) AS position
        FROM p WHERE x IS NOT NULL""",
    ),
)
def _(spark, sf):
    return xsection.ranked(panel(spark, sf), "x").select(
        "trade_date", "ts_code", F.col("x").alias("value"), "position"
    )


@query(
    "a18_quantiles",
    with_views(
        "bars_m",
        _X
        + """, o AS (SELECT trade_date, x, row_number() OVER (PARTITION BY trade_date ORDER BY x, ts_code) - 1 AS i,
                       count(*) OVER (PARTITION BY trade_date) AS n FROM p WHERE x IS NOT NULL)
        SELECT trade_date, max(n) AS count,
               max(x) FILTER (i = round_even((n - 1) * 0.1::DOUBLE, 0)) AS p10,
               max(x) FILTER (i = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50,
               max(x) FILTER (i = round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90
        FROM o GROUP BY trade_date""",
    ),
)
def _(spark, sf):
    return ordering.nearest_rank_quantiles(
        panel(spark, sf), "x", ["trade_date"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    )


_FWD = """, f AS (SELECT ts_code, trade_date, round(x, 8) AS factor,
               lead(x) OVER (PARTITION BY ts_code ORDER BY trade_date) / x - 1.0::DOUBLE AS fwd FROM p),
        ok AS (SELECT * FROM f WHERE factor IS NOT NULL AND fwd IS NOT NULL)
"""


def _factor_and_forward(spark, sf):
    from pyspark.sql import Window

    p = derived_panel(spark, sf)
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    f = p.select("ts_code", "trade_date", F.round("x", 8).alias("factor"), (F.lead("x").over(w) / F.col("x") - 1.0).alias("fwd"))
    return stage(f.where(F.col("factor").isNotNull() & F.col("fwd").isNotNull()))


@query(
    "a19_pearson_ic",
    with_views(
        "bars_m",
        _X
        + _FWD
        + "SELECT trade_date, CASE WHEN count(*) >= 3 THEN round(corr(factor, fwd), 6) END AS ic FROM ok GROUP BY 1",
    ),
)
def _(spark, sf):
    return xsection.information_coefficient(_factor_and_forward(spark, sf), "factor", "fwd", rank=False).select(
        "trade_date", F.round("ic", 6).alias("ic")
    )


_RANKS = """, rk AS (SELECT trade_date,
          rank() OVER (PARTITION BY trade_date ORDER BY factor) + (count(*) OVER (PARTITION BY trade_date, factor) - 1) / 2.0::DOUBLE AS rf,
          rank() OVER (PARTITION BY trade_date ORDER BY fwd) + (count(*) OVER (PARTITION BY trade_date, fwd) - 1) / 2.0::DOUBLE AS rr
          FROM ok)
"""


@query(
    "a20_spearman_ic",
    with_views(
        "bars_m",
        _X
        + _FWD
        + _RANKS
        + "SELECT trade_date, CASE WHEN count(*) >= 3 THEN round(corr(rf, rr), 6) END AS rank_ic FROM rk GROUP BY 1",
    ),
)
def _(spark, sf):
    return xsection.information_coefficient(_factor_and_forward(spark, sf), "factor", "fwd").select(
        "trade_date", F.round("rank_ic", 6).alias("rank_ic")
    )


@query(
    "a21_ic_summary",
    with_views(
        "bars_m",
        _X
        + _FWD
        + _RANKS
        + """, a AS (SELECT trade_date, CASE WHEN count(*) >= 3 THEN corr(factor, fwd) END AS ic FROM ok GROUP BY 1),
        b AS (SELECT trade_date, CASE WHEN count(*) >= 3 THEN corr(rf, rr) END AS rank_ic FROM rk GROUP BY 1)
        SELECT round(avg(ic), 6) AS ic_mean, round(avg(rank_ic), 6) AS rank_ic_mean,
               round(avg(ic) / stddev_samp(ic), 6) AS icir, round(avg(rank_ic) / stddev_samp(rank_ic), 6) AS rank_icir
        FROM a JOIN b USING (trade_date)""",
    ),
)
def _(spark, sf):
    ic = xsection.information_coefficient(_factor_and_forward(spark, sf), "factor", "fwd")
    s = xsection.ic_summary(ic)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    "a26_zscore_composite",
    with_views(
        "bars_m",
        _X
        + """, st AS (SELECT *, avg(x) OVER d AS mx, stddev_samp(x) OVER d AS sx, avg(y) OVER d AS my, stddev_samp(y) OVER d AS sy
                 FROM p WINDOW d AS (PARTITION BY trade_date)),
        z AS (SELECT ts_code, trade_date, CASE WHEN x IS NOT NULL THEN CASE WHEN sx > 0 THEN (x - mx) / sx ELSE 0.0 END END AS zx,
                     CASE WHEN sy > 0 THEN (y - my) / sy ELSE 0.0 END AS zy FROM st)
        SELECT ts_code, trade_date, round((coalesce(zx * 0.7::DOUBLE, 0.0) + zy * 0.3::DOUBLE)
               / (CASE WHEN zx IS NOT NULL THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END + 0.3::DOUBLE), 6) AS value FROM z""",
    ),
)
def _(spark, sf):
    return xsection.composite(panel(spark, sf), {"x": 0.7, "y": 0.3}).select(
        "ts_code", "trade_date", F.round("value", 6).alias("value")
    )
