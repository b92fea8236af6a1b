"""The domain's tables as views over the given tables, once for Spark and once as SQL text.

bars      from lineitem: one row per (supplier, month) or (supplier, day), aggregated with map-side combine
listing   one row per supplier: life span, name, texts
calendar  every day between the first and the last shipment, open on shipping weekdays
suspend   suspension notices, from lineitem flags
landing   events by (user, day): the vendor pages that land, with source and version
reports   orders as report versions by customer and quarter end
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.session import stage


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. Its files' footers are looked at once a process; queries read many tables many times."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# ── codes ────────────────────────────────────────────────────────────────

# Code prefix and exchange suffix by key modulo 16.
_PREFIX = ["600", "000", "300", "688", "601", "002", "830", "200", "603", "001", "301", "689", "605", "003", "430", "9009"]
_SUFFIX = ["SH", "SZ", "SZ", "SH", "SH", "SZ", "BJ", "SZ", "SH", "SZ", "SZ", "SH", "SH", "SZ", "BJ", "SH"]


def code(key: Column) -> Column:
    """ts_code of an integer key, in the style 600000000012.SH."""
    i = (key % 16 + 1).cast("int")
    prefix = F.element_at(F.array(*[F.lit(x) for x in _PREFIX]), i)
    suffix = F.element_at(F.array(*[F.lit(x) for x in _SUFFIX]), i)
    return F.concat(prefix, F.lpad(key.cast("string"), 12, "0"), F.lit("."), suffix)


def code_sql(key: str) -> str:
    p = "[" + ",".join(f"'{x}'" for x in _PREFIX) + "]"
    s = "[" + ",".join(f"'{x}'" for x in _SUFFIX) + "]"
    return (
        f"(({p})[CAST({key} % 16 + 1 AS INTEGER)] || lpad(CAST({key} AS VARCHAR), 12, '0') || '.' || "
        f"({s})[CAST({key} % 16 + 1 AS INTEGER)])"
    )


def ymd(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd")


# ── bars ─────────────────────────────────────────────────────────────────


def _bar_measures() -> list[Column]:
    """Open and close are the prices of the lines that come first and last by (ship day, amount, quantity).

    That order is packed into one long: 16 bits of days, then cents and quantity. Lines that tie have the same
    price, so the result is fixed, and the aggregate keeps primitive buffers (hash aggregate, map-side combine).
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    seq = (
        F.unix_date(F.to_date("l_shipdate")).cast("long") * F.lit(1 << 40)
        + F.round(F.col("l_extendedprice") * 100).cast("long") * 64
        + F.col("l_quantity").cast("long")
    )
    return [
        F.min_by(price, seq).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, seq).alias("close"),
        F.sum("l_quantity").alias("vol"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        F.max("l_discount").alias("disc"),
    ]


def _as_bars(measured: DataFrame) -> DataFrame:
    """Bars from one row per key `k` and date `d` with the measures."""
    v = F.col("vol").cast("long")
    return measured.select(
        code(F.col("k")).alias("ts_code"),
        ymd(F.col("d")).alias("trade_date"),
        "open",
        "high",
        "low",
        "close",
        "vol",
        "amount",
        F.when(v % 13 != 0, F.lit(1.0) + F.col("disc")).alias("adj_factor"),
        F.when(v % 17 != 0, F.col("open") * F.lit(1.1)).alias("up_limit"),
        F.when(v % 17 != 0, F.col("open") * F.lit(0.9)).alias("down_limit"),
    )


def _bars(spark: SparkSession, sf: str, period: Column) -> DataFrame:
    return _as_bars(table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), period.alias("d")).agg(*_bar_measures()))


def bars_m(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly bars, dated on the last day of the month."""
    return _bars(spark, sf, F.last_day(F.to_date("l_shipdate")))


def bars_d(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars."""
    return _bars(spark, sf, F.to_date("l_shipdate"))


def _bars_sql(period: str) -> str:
    seq = (
        "(CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1099511627776 + "
        "CAST(round(l_extendedprice * 100) AS BIGINT) * 64 + CAST(l_quantity AS BIGINT))"
    )
    return f"""
  SELECT {code_sql('k')} AS ts_code, strftime(d, '%Y%m%d') AS trade_date, open, high, low, close, vol, amount,
         CASE WHEN CAST(vol AS BIGINT) % 13 <> 0 THEN 1.0::DOUBLE + disc END AS adj_factor,
         CASE WHEN CAST(vol AS BIGINT) % 17 <> 0 THEN open * 1.1::DOUBLE END AS up_limit,
         CASE WHEN CAST(vol AS BIGINT) % 17 <> 0 THEN open * 0.9::DOUBLE END AS down_limit
  FROM (SELECT l_suppkey AS k, {period} AS d,
               min_by(l_extendedprice / l_quantity, {seq}) AS open,
               max(l_extendedprice / l_quantity) AS high,
               min(l_extendedprice / l_quantity) AS low,
               max_by(l_extendedprice / l_quantity, {seq}) AS close,
               sum(l_quantity) AS vol, round(sum(l_extendedprice), 2) AS amount, max(l_discount) AS disc
        FROM lineitem GROUP BY 1, 2)"""


BARS_M = f"bars_m AS MATERIALIZED ({_bars_sql('last_day(CAST(l_shipdate AS DATE))')})"
BARS_D = f"bars_d AS MATERIALIZED ({_bars_sql('CAST(l_shipdate AS DATE)')})"


# ── listing ──────────────────────────────────────────────────────────────


def _shipped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"))


def listing(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """Life spans come from the first and last shipment, shifted by key; delist_date is '', null or a date. `days`, here and
    below: the shipments by key and day (`ship_days`), to read instead of the lines."""
    k = F.col("k")
    span = (days or _shipped(spark, sf)).groupBy("k").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    named = span.join(table(spark, sf, "supplier"), F.col("k") == F.col("s_suppkey"))
    m10 = (k % 10).cast("int")
    return named.select(
        code(k).alias("ts_code"),
        F.lpad(k.cast("string"), 12, "0").alias("symbol"),
        F.concat(
            F.when(k % 9 == 0, F.lit("ST ")).otherwise(F.lit("")),
            F.col("s_name"),
            F.when(k % 11 == 0, F.lit("(退)")).otherwise(F.lit("")),
        ).alias("name"),
        F.concat(F.col("s_name"), F.lit(" 100%_Co")).alias("fullname"),
        F.element_at(F.array(*[F.lit(x) for x in ("SSE", "SZSE", "BSE", "HKEX")]), (k % 4 + 1).cast("int")).alias("exchange"),
        F.when(k % 3 == 0, F.lit("主板")).otherwise(F.lit("创业板")).alias("market"),
        F.when(k % 7 == 0, F.lit("N")).when(k % 7 == 1, F.lit("S")).otherwise(F.lit("H")).alias("is_hs"),
        (k % 2).cast("int").alias("is_ggt"),
        F.when(m10 == 9, F.lit("")).otherwise(ymd(F.date_add("lo", (k * 37 % 700).cast("int")))).alias("list_date"),
        F.when(m10.isin(2, 5), ymd(F.date_sub("hi", (k * 53 % 900).cast("int"))))
        .when(m10.isin(1, 3), F.lit(""))
        .alias("delist_date"),
    )


LISTING = f"""listing AS MATERIALIZED (
  SELECT {code_sql('k')} AS ts_code, lpad(CAST(k AS VARCHAR), 12, '0') AS symbol,
         (CASE WHEN k % 9 = 0 THEN 'ST ' ELSE '' END) || s_name || (CASE WHEN k % 11 = 0 THEN '(退)' ELSE '' END) AS name,
         s_name || ' 100%_Co' AS fullname,
         (['SSE','SZSE','BSE','HKEX'])[CAST(k % 4 + 1 AS INTEGER)] AS exchange,
         CASE WHEN k % 3 = 0 THEN '主板' ELSE '创业板' END AS market,
         CASE WHEN k % 7 = 0 THEN 'N' WHEN k % 7 = 1 THEN 'S' ELSE 'H' END AS is_hs,
         CAST(k % 2 AS INTEGER) AS is_ggt,
         CASE WHEN k % 10 = 9 THEN '' ELSE strftime(lo + CAST(k * 37 % 700 AS INTEGER), '%Y%m%d') END AS list_date,
         CASE WHEN k % 10 IN (2, 5) THEN strftime(hi - CAST(k * 53 % 900 AS INTEGER), '%Y%m%d')
              WHEN k % 10 IN (1, 3) THEN '' END AS delist_date
  FROM (SELECT l_suppkey AS k, min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi
        FROM lineitem GROUP BY 1) JOIN supplier ON k = s_suppkey)"""


# ── calendar and suspensions ─────────────────────────────────────────────


def calendar(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """One reading of the shipments, which collapse to distinct days before the shuffle; the rest is one row of days."""
    row = (days or _shipped(spark, sf)).select("d").distinct().agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.collect_set("d").alias("seen"))
    spine = row.select("seen", F.explode(F.sequence("lo", "hi")).alias("d"))
    is_open = F.array_contains("seen", F.col("d")) & F.dayofweek("d").between(2, 6)
    return spine.select(
        F.lit("SSE").alias("exchange"),
        ymd(F.col("d")).alias("cal_date"),
        F.when(is_open, F.lit("1")).otherwise(F.lit("0")).alias("is_open"),
    )


CALENDAR = """calendar AS MATERIALIZED (
  SELECT 'SSE' AS exchange, strftime(d, '%Y%m%d') AS cal_date,
         CASE WHEN n IS NOT NULL AND isodow(d) <= 5 THEN '1' ELSE '0' END AS is_open
  FROM (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d
        FROM (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem))
  LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1) USING (d))"""


# Kinds of a notice, a bit each: all-day or partial halts, and resumptions.
_KINDS = [(kind, timing) for kind in ("S", "R") for timing in ("", "09:30-10:00", None)]


def _notices() -> Column:
    """The kinds of notice that a key's lines of a day give, as bits. Every line gives one."""
    halt = (F.col("l_linenumber") <= 2) & (F.col("l_discount") < 0.03) & (F.col("l_linestatus") == "O")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2)
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.when(halt, 0).otherwise(3) + flag)).alias("notices")


def suspend(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """Suspension notices: one row for each kind that a code has on a day."""
    if days is None:
        days = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d")).agg(_notices())
    kinds = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).cast("string").alias("t"), F.lit(1 << i).alias("bit")) for i, (s, t) in enumerate(_KINDS)])
    rows = days.select("k", "d", F.explode(F.filter(kinds, lambda x: F.col("notices").bitwiseAND(x["bit"]) != 0)).alias("n"))
    return rows.select(code(F.col("k")).alias("ts_code"), ymd(F.col("d")).alias("trade_date"), F.col("n.s").alias("suspend_type"), F.col("n.t").alias("suspend_timing"))


SUSPEND = f"""suspend AS MATERIALIZED (
  SELECT DISTINCT {code_sql('l_suppkey')} AS ts_code, strftime(CAST(l_shipdate AS DATE), '%Y%m%d') AS trade_date,
         CASE WHEN l_linenumber <= 2 AND l_discount < 0.03 AND l_linestatus = 'O' THEN 'S' ELSE 'R' END AS suspend_type,
         CASE WHEN l_returnflag = 'A' THEN '' WHEN l_returnflag = 'R' THEN '09:30-10:00' END AS suspend_timing
  FROM lineitem)"""


# ── shared readings ──────────────────────────────────────────────────────

# The lines of a day are dealt to the watched sources by this many classes.
SOURCE_CLASSES = 8


def source_class() -> Column:
    return F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(SOURCE_CLASSES))


@dataclass(frozen=True)
class Market:
    """The market's tables from one reading of the shipments: an aggregate by key and day, staged, from which listing,
    calendar (staged too: a row per code, a row per day), notices, bars and counts by source follow."""

    days: DataFrame
    listing: DataFrame
    calendar: DataFrame
    suspend: DataFrame
    bars: DataFrame | None


def market(spark: SparkSession, sf: str, bars: bool = False, sources: bool = False) -> Market:
    dealt = [F.count_if(source_class() == i).alias(f"s{i}") for i in range(SOURCE_CLASSES if sources else 0)]
    by = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"))
    days = stage(by.agg(_notices(), *dealt, *(_bar_measures() if bars else [])))
    known = stage(listing(spark, sf, days)), stage(calendar(spark, sf, days))
    return Market(days, *known, suspend(spark, sf, days), _as_bars(days) if bars else None)


# ── landing, reports ─────────────────────────────────────────────────────


def landing(spark: SparkSession, sf: str) -> DataFrame:
    """Every event is one landed vendor row for (user, day); event_id is the order of arrival."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.lpad(F.col("user_id").cast("string"), 12, "0")).alias("ts_code"),
        ymd(F.to_date("ts")).alias("trade_date"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("trade_time"),
        F.col("event_type").alias("source"),
        F.col("event_id").alias("ordinal"),
        "value",
        "props",
    )


LANDING = """landing AS MATERIALIZED (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS ts_code, strftime(CAST(ts AS DATE), '%Y%m%d') AS trade_date,
         strftime(ts, '%Y%m%d%H%M%S') AS trade_time, event_type AS source, event_id AS ordinal, value, props
  FROM events)"""


def quarter_end(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is one version of a customer's report for the quarter of its date."""
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("ts_code"),
        ymd(quarter_end(d)).alias("end_date"),
        ymd(F.date_add(quarter_end(d), (F.col("o_orderkey") % 90).cast("int"))).alias("ann_date"),
        F.substring("o_orderpriority", 1, 1).alias("report_type"),
        F.when(F.col("o_orderstatus") == "F", F.lit("1")).otherwise(F.lit("0")).alias("update_flag"),
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_totalprice").alias("total_revenue"),
    )


REPORTS = """reports AS MATERIALIZED (
  SELECT 'C' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS ts_code, strftime(q, '%Y%m%d') AS end_date,
         strftime(q + CAST(o_orderkey % 90 AS INTEGER), '%Y%m%d') AS ann_date, substr(o_orderpriority, 1, 1) AS report_type,
         CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS update_flag, o_orderkey AS ordinal,
         o_totalprice AS total_revenue
  FROM (SELECT *, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS q FROM orders))"""


REPORT_TYPES = "12345"


def report_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """One reading of the orders: per company key and quarter end the reports of each type (n1...), those updated (u1...),
    and the first and last order day. Staged."""
    d, kind = F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    done = F.col("o_orderstatus") == "F"
    counts = [F.count_if(kind == t).alias(f"n{t}") for t in REPORT_TYPES] + [F.count_if((kind == t) & done).alias(f"u{t}") for t in REPORT_TYPES]
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), ymd(quarter_end(d)).alias("end_date"))
    return stage(by.agg(F.min(d).alias("lo"), F.max(d).alias("hi"), *counts))


def companies(spark: SparkSession, sf: str, quarters: DataFrame | None = None) -> DataFrame:
    """One row per reporting company: life span from its first and last order (of `report_quarters`, if given)."""
    k, d = F.col("k"), F.to_date("o_orderdate")
    rows = quarters or table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), d.alias("lo"), d.alias("hi"))
    span = rows.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    m10 = (k % 10).cast("int")
    return span.select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 12, "0")).alias("ts_code"),
        F.when(m10 == 9, F.lit("")).otherwise(ymd(F.date_add("lo", (k * 37 % 400).cast("int")))).alias("list_date"),
        F.when(m10.isin(2, 5), ymd(F.date_sub("hi", (k * 53 % 300).cast("int"))))
        .when(m10.isin(1, 3), F.lit(""))
        .alias("delist_date"),
    )


COMPANIES = """companies AS MATERIALIZED (
  SELECT 'C' || lpad(CAST(k AS VARCHAR), 12, '0') AS ts_code,
         CASE WHEN k % 10 = 9 THEN '' ELSE strftime(lo + CAST(k * 37 % 400 AS INTEGER), '%Y%m%d') END AS list_date,
         CASE WHEN k % 10 IN (2, 5) THEN strftime(hi - CAST(k * 53 % 300 AS INTEGER), '%Y%m%d')
              WHEN k % 10 IN (1, 3) THEN '' END AS delist_date
  FROM (SELECT o_custkey AS k, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi
        FROM orders GROUP BY 1))"""


# Index codes that stand for the return flags.
_INDEX = {"A": "000300.SH", "N": "000905.SH", "R": "000852.SH"}


def index_m(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly index bars, one index per return flag."""
    c = F.col("l_returnflag")
    index_code = F.when(c == "A", F.lit(_INDEX["A"])).when(c == "N", F.lit(_INDEX["N"])).otherwise(F.lit(_INDEX["R"]))
    g = (
        table(spark, sf, "lineitem")
        .groupBy(index_code.alias("ts_code"), F.last_day(F.to_date("l_shipdate")).alias("d"))
        .agg(
            F.round(F.avg("l_extendedprice"), 3).alias("open"),
            F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 3).alias("close"),
        )
    )
    return g.select("ts_code", ymd(F.col("d")).alias("trade_date"), "open", "close")


INDEX_M = f"""index_m AS MATERIALIZED (
  SELECT CASE l_returnflag WHEN 'A' THEN '{_INDEX['A']}' WHEN 'N' THEN '{_INDEX['N']}' ELSE '{_INDEX['R']}' END AS ts_code,
         strftime(last_day(CAST(l_shipdate AS DATE)), '%Y%m%d') AS trade_date,
         round(avg(l_extendedprice), 3) AS open, round(sum(l_extendedprice) / sum(l_quantity), 3) AS close
  FROM lineitem GROUP BY 1, 2)"""


_CTES = {
    "bars_m": BARS_M,
    "bars_d": BARS_D,
    "listing": LISTING,
    "calendar": CALENDAR,
    "suspend": SUSPEND,
    "landing": LANDING,
    "reports": REPORTS,
    "companies": COMPANIES,
    "index_m": INDEX_M,
}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views in front. A body that starts with a comma-free WITH list may add its own
    views after a leading '&'."""
    ctes = ",\n".join(_CTES[n] for n in names.split())
    body = body.strip()
    if body.startswith("&"):
        return f"WITH {ctes},\n{body[1:].strip()}"
    return f"WITH {ctes}\n{body}"
