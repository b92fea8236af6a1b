"""N: JSON and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.joins import FACTORS_SQL, factors_long
from barloom.catalog.registry import query
from barloom.catalog.views import landing, reports, table, with_views
from barloom.operators import nested
from barloom.session import stage

DOC_SQL = """('{' || array_to_string(list_filter([
     CASE WHEN ordinal % 3 <> 0 THEN '"note":"n' || (ordinal % 7) || '"' END,
     '"lines":' || (ordinal % 9),
     CASE WHEN ordinal % 5 <> 0 THEN '"rate":1.5' END], lambda v: v IS NOT NULL), ',') || '}')"""


def landed_reports(spark, sf):
    """Reports with three columns that no table has."""
    k = F.col("ordinal")
    return reports(spark, sf).withColumns(
        {
            "note": F.when(k % 6 == 0, F.lit("  ")).when(k % 3 != 0, F.concat(F.lit("n"), (k % 7).cast("string"))),
            "lines": k % 9,
            "rate": F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(1.5)),
        }
    )


@query("n1_json_overflow", with_views("reports", f"SELECT ts_code, end_date, ordinal, total_revenue, {DOC_SQL} AS income_table FROM reports"))
def _(spark, sf):
    model = ["ts_code", "end_date", "ordinal", "total_revenue"]
    r = landed_reports(spark, sf).drop("ann_date", "report_type", "update_flag")
    return nested.pack_overflow(r, model, "income_table")


_COMBOS = [
    ("growth", '[{"factor_name": "mom3", "weight": 0.6}, {"factor_name": "volume", "weight": 0.4}]'),
    ("calm", '[{"factor_name": "spread"}, {"factor_name": "volume", "weight": 2}, {"factor_name": "mom3", "weight": 0}]'),
    ("single", '[{"factor_name": "spread", "weight": 1}]'),
]


@query(
    "n3_combo_scores",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """, items(combo, factor_name, weight) AS (VALUES ('growth', 'mom3', 0.6::DOUBLE), ('growth', 'volume', 0.4::DOUBLE),
          ('calm', 'spread', 1.0::DOUBLE), ('calm', 'volume', 2.0::DOUBLE), ('calm', 'mom3', 1.0::DOUBLE)),
        st AS (SELECT factor_name, trade_date, avg(value) AS m, stddev_samp(value) AS s FROM factors GROUP BY 1, 2),
        z AS (SELECT f.*, CASE WHEN s > 0 THEN (value - m) / s ELSE 0.0::DOUBLE END AS z FROM factors f JOIN st USING (factor_name, trade_date)),
        sc AS (SELECT combo, trade_date, ts_code, sum(z * weight) / sum(weight) AS value FROM z JOIN items USING (factor_name) GROUP BY 1, 2, 3)
        SELECT combo, trade_date, ts_code, round(value, 6) AS value,
               row_number() OVER (PARTITION BY combo, trade_date ORDER BY value DESC, ts_code) AS position FROM sc""",
    ),
)
def _(spark, sf):
    combos = spark.createDataFrame(_COMBOS, "combo string, items string")
    out = nested.score_combos(stage(factors_long(spark, sf)), combos)
    return out.select("combo", "trade_date", "ts_code", F.round("value", 6).alias("value"), "position")


@query(
    "n4_matrix_to_long",
    with_views(
        "landing",
        """SELECT trade_date, source AS ts_code, max(value) FILTER (value > 20) AS close, min(value) FILTER (value > 1) AS open,
             count(*)::DOUBLE AS vol FROM landing GROUP BY 1, 2 HAVING max(value) FILTER (value > 20) IS NOT NULL""",
    ),
)
def _(spark, sf):
    codes = ["click", "error", "purchase", "signup", "view"]
    g = landing(spark, sf).groupBy("trade_date").pivot("source", codes)
    big, low = F.when(F.col("value") > 20, F.col("value")), F.when(F.col("value") > 1, F.col("value"))
    matrices = {"close": g.agg(F.max(big)), "open": g.agg(F.min(low)), "vol": g.agg(F.count(F.lit(1)).cast("double"))}
    return nested.matrices_to_long(matrices, "trade_date")


@query(
    "n5_run_summary",
    """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS sharpe,
       CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS ic_mean,
       CAST(NULL AS DOUBLE) AS mdd FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    doc = F.when(k % 10 == 0, F.lit("broken")).otherwise(
        F.to_json(F.struct(F.col("o_totalprice").alias("sharpe"), F.when(k % 4 != 0, F.col("o_custkey")).alias("ic_mean")))
    )
    runs = table(spark, sf, "orders").select(k.alias("run_id"), doc.alias("summary_json"))
    return nested.summary_fields(runs, "summary_json", {"sharpe": "double", "ic_mean": "double", "mdd": "double"})


@query(
    "n5b_event_props",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    return nested.summary_fields(e, "props", {"k": "bigint"})
