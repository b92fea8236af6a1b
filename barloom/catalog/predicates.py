"""P: filters, predicates and contract projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.registry import query
from barloom.catalog.views import bars_d, bars_m, calendar, landing, listing, suspend, table, with_views
from barloom.functions.scalars import limit_hit
from barloom.operators import filters, gaps, spine, universe
from barloom.sources import contracts
from barloom.sources.tables import CONTRACTS

_LISTED = "list_date IS NOT NULL AND list_date <> '' AND list_date <= {d} AND (delist_date IS NULL OR delist_date = '' OR delist_date > {d})"
LIMIT_SQL = "(coalesce(close >= up_limit * 0.999::DOUBLE, false) OR coalesce(close <= down_limit * 1.001::DOUBLE, false))"
FULL_DAY_SQL = "suspend_type = 'S' AND coalesce(suspend_timing, '') = ''"


@query(
    "p1_in_filter",
    with_views(
        "bars_m",
        """SELECT ts_code, trade_date, close FROM bars_m
        WHERE trade_date BETWEEN '19970101' AND '19981231' AND right(ts_code, 2) IN ('SH', 'BJ')""",
    ),
)
def _(spark, sf):
    b = filters.where_between(bars_m(spark, sf), "trade_date", "19970101", "19981231")
    b = filters.where_in(b.withColumn("exchange", F.right("ts_code", F.lit(2))), "exchange", ["SH", "BJ"])
    return b.select("ts_code", "trade_date", "close")


@query("p2_listed_as_of", with_views("listing", f"SELECT ts_code, list_date, delist_date FROM listing WHERE {_LISTED.format(d=chr(39)+'19961231'+chr(39))}"))
def _(spark, sf):
    on = universe.listed_on(F.lit("19961231"), F.col("list_date"), F.col("delist_date"))
    return listing(spark, sf).where(on).select("ts_code", "list_date", "delist_date")


@query(
    "p4_security_search",
    with_views(
        "listing",
        """SELECT ts_code, name, market, is_ggt FROM listing
        WHERE lower(name) LIKE '%supplier#0000%' AND lower(fullname) LIKE '%100\\%\\_co%' ESCAPE '\\'
          AND market = '主板' AND is_ggt = 1""",
    ),
)
def _(spark, sf):
    hit = universe.search(
        listing(spark, sf), {"name": "SUPPLIER#0000", "fullname": "100%_co"}, {"market": "主板"}, {"is_ggt": "Y"}
    )
    return hit.select("ts_code", "name", "market", "is_ggt").orderBy("ts_code")


P5_SQL = f"""& reb AS (SELECT max(cal_date) AS trade_date FROM calendar WHERE is_open = '1' GROUP BY substr(cal_date, 1, 6)),
  uni AS (SELECT r.trade_date, l.ts_code FROM reb r JOIN listing l
    ON l.exchange IN ('SSE', 'SZSE', 'BSE') AND {_LISTED.format(d='r.trade_date')}
    AND upper(l.name) NOT LIKE '%ST%'
    AND l.list_date <= strftime(CAST(strptime(r.trade_date, '%Y%m%d') AS DATE) - 60, '%Y%m%d')
    WHERE NOT EXISTS (SELECT 1 FROM suspend s WHERE s.ts_code = l.ts_code AND s.trade_date = r.trade_date AND {FULL_DAY_SQL}))
"""


@query("p5_investable_universe", with_views("listing calendar suspend", P5_SQL + "SELECT trade_date, ts_code FROM uni"))
def _(spark, sf):
    li = listing(spark, sf)
    days = spine.last_of_period(spine.open_dates(calendar(spark, sf)), "monthly").select("trade_date")
    candidates = gaps.expected_grid(li, days)
    return universe.investable(candidates, li, suspend(spark, sf)).select("trade_date", "ts_code")


@query("p6_full_day_suspension", with_views("suspend", f"SELECT DISTINCT ts_code, trade_date FROM suspend WHERE {FULL_DAY_SQL}"))
def _(spark, sf):
    return universe.full_day_suspended(suspend(spark, sf))


@query("p7_limit_hit", with_views("bars_d", f"SELECT ts_code, trade_date, {LIMIT_SQL} AS blocked FROM bars_d"))
def _(spark, sf):
    hit = limit_hit(F.col("close"), F.col("up_limit"), F.col("down_limit"))
    return bars_d(spark, sf).select("ts_code", "trade_date", hit.alias("blocked"))


@query(
    "p10_table_slice",
    with_views(
        "bars_m",
        """SELECT trade_date, ts_code, vol, count(*) OVER () AS total_rows FROM bars_m
        WHERE trade_date >= '19990101' ORDER BY trade_date, ts_code LIMIT 250""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf).select("trade_date", "ts_code", "vol")
    return filters.table_slice(b, 250, ["trade_date", "ts_code"], start="19990101")


@query(
    "p11_contract_projection",
    with_views(
        "landing",
        """SELECT ts_code, trade_date, '' AS buyer, '' AS seller, value AS price, CAST(NULL AS DOUBLE) AS vol,
           TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS amount
        FROM landing WHERE ordinal % 97 <> 0""",
    ),
)
def _(spark, sf):
    raw = landing(spark, sf).select(
        "ts_code",
        F.when(F.col("ordinal") % 97 == 0, F.lit("2024-1")).otherwise(F.col("trade_date")).alias("trade_date"),
        F.col("value").alias("price"),
        F.regexp_extract("props", "[0-9]+", 0).alias("amount"),
        F.col("source").alias("unknown"),
    )
    return contracts.conform(raw, contracts.BLOCK_TRADE)


@query(
    "p11b_contract_normalised",
    with_views(
        "landing",
        """SELECT ts_code, trade_date, CASE WHEN ordinal % 3 = 0 THEN '' ELSE source END AS buyer, '' AS seller,
           CASE WHEN ordinal % 4 < 2 THEN NULL ELSE value END AS price, CAST(NULL AS DOUBLE) AS vol, CAST(NULL AS DOUBLE) AS amount
        FROM landing WHERE ordinal % 97 <> 0""",
    ),
)
def _(spark, sf):
    """Dashed days, numbers as text among which nan and inf, and texts that stand for nothing."""
    k = F.col("ordinal")
    dashed = F.concat_ws("-", F.substring("trade_date", 1, 4), F.substring("trade_date", 5, 2), F.substring("trade_date", 7, 2))
    raw = landing(spark, sf).select(
        "ts_code",
        F.when(k % 97 == 0, F.lit("2024-1")).when(k % 2 == 0, dashed).otherwise(F.col("trade_date")).alias("trade_date"),
        F.when(k % 3 == 0, F.element_at(F.array(*map(F.lit, ("None", "nan", " ", "NULL"))), (k % 4 + 1).cast("int"))).otherwise(F.col("source")).alias("buyer"),
        F.when(k % 4 == 0, F.lit("nan")).when(k % 4 == 1, F.lit("inf")).otherwise(F.col("value").cast("string")).alias("price"),
    )
    return contracts.conform(raw, contracts.BLOCK_TRADE)


@query("p12_rename", "SELECT c_custkey AS ts_code, c_name AS name, c_acctbal AS amount FROM customer")
def _(spark, sf):
    mapping = {"c_custkey": "ts_code", "c_name": "name", "c_acctbal": "amount", "c_missing": "x"}
    return contracts.rename(table(spark, sf, "customer"), mapping, keep_rest=False)


@query(
    "p12b_rename_keep",
    "SELECT c_custkey AS ts_code, c_name AS name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(spark, sf):
    return contracts.rename(table(spark, sf, "customer"), {"c_custkey": "ts_code", "c_name": "name"})


@query(
    "p13_usable_result",
    with_views(
        "bars_m",
        """SELECT 'bars' AS source, count(*) > 0 AS usable FROM bars_m
        UNION ALL SELECT 'no_rows', count(*) > 0 FROM bars_m WHERE trade_date > '2100'
        UNION ALL SELECT 'no_column', false""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf)
    need = ["ts_code", "trade_date", "close", "adj_factor"]
    found = [
        ("bars", contracts.usable(b, need)),
        ("no_rows", contracts.usable(b.where("trade_date > '2100'"), need)),
        ("no_column", contracts.usable(b.drop("adj_factor"), need)),
    ]
    return spark.createDataFrame(found, "source string, usable boolean")


@query("p14_all_a", with_views("listing", "SELECT ts_code, exchange FROM listing WHERE exchange IN ('SSE', 'SZSE', 'BSE')"))
def _(spark, sf):
    return universe.a_shares(listing(spark, sf)).select("ts_code", "exchange")


@query(
    "p15_index_codes",
    with_views(
        "listing index_m",
        """SELECT '000300.SH' AS ts_code UNION SELECT '399006.SZ'
        UNION SELECT ts_code FROM listing WHERE exchange IN ('SSE', 'SZSE') AND market = '主板'""",
    ),
)
def _(spark, sf):
    fixed = spark.createDataFrame([("000300.SH",), ("399006.SZ",)], "ts_code string")
    composite = listing(spark, sf).where(F.col("exchange").isin("SSE", "SZSE") & (F.col("market") == "主板")).select("ts_code")
    return fixed.union(composite).distinct().orderBy("ts_code")


_TIGER_NUMBERS = ("close", "pct_change", "turnover_rate", "amount", "l_sell", "l_buy", "l_amount", "net_amount", "net_rate", "amount_rate")


@query(
    "p11c_dragon_tiger_contract",
    with_views(
        "landing",
        f"""SELECT trade_date, ts_code, CAST(NULL AS VARCHAR) AS name, CASE WHEN ordinal % 4 <> 0 THEN source END AS reason,
          {", ".join(f"CASE WHEN ordinal % 3 <> 0 THEN value END AS {c}" if c == "amount" else f"CAST(NULL AS DOUBLE) AS {c}" for c in _TIGER_NUMBERS)},
          value AS float_value FROM landing WHERE ordinal % 11 <> 0""",
    ),
)
def _(spark, sf):
    """A vendor's page under its own names: a renamed column, days with dashes and without, numbers as text, texts for nothing."""
    k = F.col("ordinal")
    page = landing(spark, sf).select(
        F.concat(F.lit(" "), F.col("ts_code"), F.lit(" ")).alias("ts_code"),
        F.when(k % 11 == 0, F.lit("2024-1")).when(k % 2 == 0, F.date_format(F.to_date("trade_date", "yyyyMMdd"), "yyyy-MM-dd")).otherwise(F.col("trade_date")).alias("trade_date"),
        F.when(k % 4 == 0, F.lit("None")).otherwise(F.col("source")).alias("reason"),
        F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.col("value").alias("float_values"),
        F.lit("x").alias("vendor_extra"),
    )
    return contracts.conform(page, CONTRACTS["market_dragon_tiger_list"])


@query(
    "p11d_suspension_contract",
    with_views(
        "suspend",
        """SELECT ts_code, trade_date, coalesce(suspend_timing, '') AS suspend_timing, suspend_type FROM suspend WHERE suspend_type = 'S' OR trade_date < '1997'""",
    ),
)
def _(spark, sf):
    """Types in small letters are stored in capitals; rows of other types go."""
    kind = F.when((F.col("suspend_type") == "S") | (F.col("trade_date") < "1997"), F.lower("suspend_type")).otherwise(F.lit("x"))
    return contracts.conform(suspend(spark, sf).withColumn("suspend_type", kind), CONTRACTS["stock_suspend"])
