"""S: sources and sinks. Each query writes the derived table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import bars_d, bars_m, index_m, table, with_views
from barloom.operators import merge
from barloom.session import scratch_path
from barloom.sources import bars as B
from barloom.sources import contracts, sinks

_BAR14 = """ts_code, trade_date, open, high, low, close, CAST(NULL AS DOUBLE) AS pre_close, CAST(NULL AS DOUBLE) AS change,
  CAST(NULL AS DOUBLE) AS pct_chg, vol, amount, adj_factor, up_limit, down_limit"""
_ADJ = ", ".join(f"{c} * coalesce(adj_factor, 1.0) AS {c}_adj" for c in ("open", "high", "low", "close"))


def bar_root(spark, sf) -> str:
    root = scratch_path(spark, "warehouse")
    sinks.write_bars(bars_m(spark, sf), root)
    return root


@query("s1_month_scan", with_views("bars_m", f"SELECT {_BAR14} FROM bars_m WHERE substr(trade_date, 1, 6) IN ('199703', '199811')"))
def _(spark, sf):
    return B.BarStore(spark, bar_root(spark, sf)).read_months(["199703", "199811"])


@query(
    "s2_month_with_window",
    with_views("bars_m", f"SELECT ts_code, trade_date, {_ADJ} FROM bars_m WHERE substr(trade_date, 1, 6) BETWEEN '199705' AND '199709'"),
)
def _(spark, sf):
    b = B.BarStore(spark, bar_root(spark, sf)).read_month_with_window("199709", 60)
    return b.select("ts_code", "trade_date", *[f"{c}_adj" for c in B.PRICES])


@query(
    "s3_range_scan",
    with_views(
        "bars_m",
        f"""SELECT ts_code, trade_date, close, {_ADJ} FROM bars_m WHERE trade_date BETWEEN '19970215' AND '19980615'
        AND ts_code IN (SELECT DISTINCT ts_code FROM bars_m WHERE close > 9000)""",
    ),
)
def _(spark, sf):
    codes = bars_m(spark, sf).where("close > 9000").select("ts_code")
    b = B.BarStore(spark, bar_root(spark, sf)).read_range("19970215", "19980615", codes)
    return b.select("ts_code", "trade_date", "close", *[f"{c}_adj" for c in B.PRICES])


@query("s4_adjusted_prices", with_views("bars_d", f"SELECT ts_code, trade_date, {_ADJ} FROM bars_d"))
def _(spark, sf):
    return B.with_adjusted(bars_d(spark, sf)).select("ts_code", "trade_date", *[f"{c}_adj" for c in B.PRICES])


@query("s5_month_listing", with_views("bars_m", "SELECT DISTINCT substr(trade_date, 1, 6) AS dt FROM bars_m"))
def _(spark, sf):
    return B.BarStore(spark, bar_root(spark, sf)).months()


def factor_root(spark, sf) -> str:
    from barloom.catalog.joins import factors_long

    root = scratch_path(spark, "warehouse")
    sinks.write_factors(factors_long(spark, sf), root)
    return root


def _factors():
    from barloom.catalog.joins import FACTORS_SQL

    return "&" + FACTORS_SQL[1:]


@query(
    "s6_factor_scan",
    with_views(
        "bars_m",
        _factors() + "SELECT ts_code, trade_date, round(value, 8) AS value FROM factors WHERE factor_name = 'spread' AND trade_date BETWEEN '19970110' AND '19990831'",
    ),
)
def _(spark, sf):
    f = B.FactorStore(spark, factor_root(spark, sf)).read("spread", "19970110", "19990831")
    return f.select("ts_code", "trade_date", F.round("value", 8).alias("value"))


@query(
    "s7_factor_catalogue",
    with_views(
        "bars_m",
        _factors()
        + """SELECT factor_name, min(substr(trade_date, 1, 6)) AS first_month, max(substr(trade_date, 1, 6)) AS last_month,
          count(DISTINCT substr(trade_date, 1, 6)) AS month_count FROM factors GROUP BY 1""",
    ),
)
def _(spark, sf):
    return B.FactorStore(spark, factor_root(spark, sf)).catalogue()


@query("s8_index_scan", with_views("index_m", "SELECT * FROM index_m WHERE ts_code = '000300.SH'"))
def _(spark, sf):
    path = scratch_path(spark, "index_daily")
    index_m(spark, sf).write.parquet(path)
    return B.index_scan(spark, path, "000300.SH")


@query(
    "s9_partition_overwrite",
    with_views(
        "bars_m",
        """SELECT substr(trade_date, 1, 6) AS dt, count(*) AS n_rows, round(sum(close * CASE WHEN substr(trade_date, 1, 6) = '199805' THEN 2 ELSE 1 END), 3) AS close
        FROM bars_m WHERE NOT (substr(trade_date, 1, 6) = '199805' AND vol <= 200) GROUP BY 1""",
    ),
)
def _(spark, sf):
    root = scratch_path(spark, "warehouse")
    b = bars_m(spark, sf)
    sinks.write_bars(b, root)
    again = b.where("substr(trade_date, 1, 6) = '199805' AND vol > 200").withColumn("close", F.col("close") * 2)
    sinks.write_bars(again, root)
    t = B.BarStore(spark, root).table()
    return t.groupBy("dt").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("close"), 3).alias("close"))


@query(
    "s9b_writer_settings",
    with_views("bars_m", "SELECT count(DISTINCT substr(trade_date, 1, 6)) AS months, true AS zstd FROM bars_m"),
)
def _(spark, sf):
    root = bar_root(spark, sf)
    files = B.partitions(spark, f"{root}/kline_daily")
    return files.agg(F.countDistinct("dt").alias("months"), F.bool_and(F.col("path").contains(".zstd.")).alias("zstd"))


@query(
    "s10_factor_sink",
    with_views(
        "bars_m",
        _factors()
        + """SELECT factor_name, ts_code, trade_date, round(CASE WHEN factor_name = 'volume' AND substr(trade_date, 1, 6) = '199805' THEN value * 2 ELSE value END, 8) AS value,
          substr(trade_date, 1, 6) AS dt FROM factors""",
    ),
)
def _(spark, sf):
    """All values after one factor of one month was written anew: the other factors of the month stay."""
    root = factor_root(spark, sf)
    from barloom.catalog.joins import factors_long

    volume = factors_long(spark, sf).where("factor_name = 'volume' AND substring(trade_date, 1, 6) = '199805'")
    sinks.write_factors(volume.withColumn("value", F.col("value") * 2), root)
    t = B.FactorStore(spark, root).table()
    return t.select("factor_name", "ts_code", "trade_date", F.round("value", 8).alias("value"), "dt")


def vendor_wide(spark, sf):
    return bars_m(spark, sf).select(
        "ts_code",
        "trade_date",
        F.col("close").alias("close_hfq"),
        F.col("vol").cast("int").alias("downdays"),
        F.when(F.col("vol").cast("long") % 3 == 0, F.col("high")).alias("ma_hfq_5"),
    )


VENDOR_SQL = """vendor AS (SELECT ts_code, trade_date, 'close' AS factor_name, close AS value FROM bars_m
   UNION ALL SELECT ts_code, trade_date, 'down_streak', vol FROM bars_m
   UNION ALL SELECT ts_code, trade_date, 'ma_5', high FROM bars_m WHERE CAST(vol AS BIGINT) % 3 = 0)"""


@query("s11_wide_to_long_sink", with_views("bars_m", f"& {VENDOR_SQL} SELECT * FROM vendor"))
def _(spark, sf):
    root = scratch_path(spark, "warehouse")
    sinks.write_factors(sinks.vendor_long(vendor_wide(spark, sf)), root)
    return B.FactorStore(spark, root).table().select("ts_code", "trade_date", "factor_name", "value")


@query("s12_cast_to_double", "SELECT ps.p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part ps")
def _(spark, sf):
    return contracts.to_double(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_partkey"])


@query("s13_export_contract", with_views("bars_d", f"SELECT {_BAR14} FROM bars_d"))
def _(spark, sf):
    root = scratch_path(spark, "warehouse")
    sinks.write_bars(bars_d(spark, sf).withColumn("vendor_extra", F.lit(1)), root)
    files = spark.read.option("recursiveFileLookup", "true")  # the file content alone, without the partition column
    return files.parquet(f"{root}/kline_daily")


@query(
    "s14_month_of_store",
    with_views("bars_d", "SELECT ts_code, trade_date, close, vol FROM bars_d WHERE trade_date BETWEEN '19980301' AND '19980331'"),
)
def _(spark, sf):
    path = scratch_path(spark, "kline_daily_landing")
    bars_d(spark, sf).write.parquet(path)
    t = spark.read.parquet(path).where(F.col("trade_date").between("19980301", "19980331"))
    return t.select("ts_code", "trade_date", "close", "vol").orderBy("trade_date", "ts_code")


# ── upserts ──────────────────────────────────────────────────────────────

_OLD_NEW = """& old AS (SELECT ts_code, trade_date, close, vol, adj_factor FROM bars_m WHERE CAST(vol AS BIGINT) % 3 <> 0),
  new AS (SELECT ts_code, trade_date, close * 2 AS close, vol + 1 AS vol FROM bars_m WHERE CAST(vol AS BIGINT) % 2 = 0)
"""


def _old_new(spark, sf):
    b = bars_m(spark, sf)
    v = F.col("vol").cast("long")
    old = b.where(v % 3 != 0).select("ts_code", "trade_date", "close", "vol", "adj_factor")
    new = b.where(v % 2 == 0).select("ts_code", "trade_date", (F.col("close") * 2).alias("close"), (F.col("vol") + 1).alias("vol"))
    return old, new


@query(
    "s15_upsert",
    with_views(
        "bars_m",
        _OLD_NEW
        + """SELECT coalesce(n.ts_code, o.ts_code) AS ts_code, coalesce(n.trade_date, o.trade_date) AS trade_date,
          coalesce(n.close, o.close) AS close, coalesce(n.vol, o.vol) AS vol, o.adj_factor
        FROM old o FULL JOIN new n ON o.ts_code = n.ts_code AND o.trade_date = n.trade_date""",
    ),
)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return merge.upsert(old, new, ["ts_code", "trade_date"])


@query(
    "s16_upsert_columns",
    with_views(
        "bars_m",
        _OLD_NEW
        + """SELECT coalesce(n.ts_code, o.ts_code) AS ts_code, coalesce(n.trade_date, o.trade_date) AS trade_date,
          coalesce(n.close, o.close) AS close, o.vol, o.adj_factor
        FROM old o FULL JOIN new n ON o.ts_code = n.ts_code AND o.trade_date = n.trade_date""",
    ),
)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return merge.upsert(old, new, ["ts_code", "trade_date"], update=["close"])


@query(
    "s17_insert_absent",
    with_views(
        "bars_m",
        _OLD_NEW
        + """SELECT ts_code, trade_date, close, vol FROM old UNION ALL
        SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.ts_code = n.ts_code AND o.trade_date = n.trade_date)""",
    ),
)
def _(spark, sf):
    old, new = _old_new(spark, sf)
    return merge.insert_absent(old.drop("adj_factor"), new, ["ts_code", "trade_date"])


@query(
    "s18_length_check",
    """SELECT 'c_name' AS column_name, 10 AS declared, max(length(c_name))::INTEGER AS longest, count(*) FILTER (length(c_name) > 10) AS n_rows,
         min(c_name) FILTER (length(c_name) > 10) AS example FROM customer
    UNION ALL SELECT 'c_mktsegment', 9, max(length(c_mktsegment))::INTEGER, count(*) FILTER (length(c_mktsegment) > 9),
         min(c_mktsegment) FILTER (length(c_mktsegment) > 9) FROM customer HAVING max(length(c_mktsegment)) > 9""",
)
def _(spark, sf):
    return contracts.length_offenders(table(spark, sf, "customer"), {"c_name": 10, "c_mktsegment": 9})


@query(
    "s20_hot_table",
    with_views(
        "bars_m",
        _factors()
        + """, r AS (SELECT DISTINCT trade_date FROM bars_m ORDER BY 1 DESC LIMIT 6)
        SELECT ts_code, trade_date, round(max(value) FILTER (factor_name = 'mom3'), 8) AS mom3,
          max(value) FILTER (factor_name = 'volume') AS volume, round(max(value) FILTER (factor_name = 'spread'), 8) AS spread
        FROM factors WHERE trade_date IN (SELECT trade_date FROM r) GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    from barloom.catalog.joins import factors_long
    from barloom.plans import hot_table

    h = hot_table.build(factors_long(spark, sf), bars_m(spark, sf), ["mom3", "volume", "spread"], 6)
    path = scratch_path(spark, "factor_latest")
    h.write.mode("overwrite").parquet(path)
    t = spark.read.parquet(path)
    return t.select("ts_code", "trade_date", F.round("mom3", 8).alias("mom3"), "volume", F.round("spread", 8).alias("spread"))
