"""U: unions, de-duplication, set differences, the missing registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.aggregates import _PERIODS_SQL, LOG_SQL, due_periods, missing_log
from barloom.catalog.joins import FACTORS_SQL, LISTED_SQL, factors_long
from barloom.catalog.registry import query
from barloom.catalog.views import bars_d, bars_m, calendar, companies, index_m, landing, listing, reports, table, with_views
from barloom.operators import daybits, dedup, gaps, registry, spine
from barloom.plans import completeness_jobs as jobs
from barloom.plans import hot_table


@query(
    "u1_keep_first",
    with_views(
        "landing",
        """SELECT ts_code, trade_date, source, value, ordinal FROM landing
        QUALIFY row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY (source = 'error')::INT, ordinal) = 1""",
    ),
)
def _(spark, sf):
    la = landing(spark, sf).select("ts_code", "trade_date", "source", "value", "ordinal")
    pages = dedup.union_pages([la.where("source <> 'error'"), la.where("source = 'error'")])
    first = dedup.first_by(pages, ["ts_code", "trade_date"], [F.col("page_no"), F.col("ordinal")])
    return first.select("ts_code", "trade_date", "source", "value", "ordinal")


@query(
    "u2_keep_last",
    with_views(
        "landing",
        """SELECT ts_code, source, value, ordinal FROM landing
        QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY list_position(['click', 'view', 'signup', 'purchase', 'error'], source) DESC, ordinal DESC) = 1""",
    ),
)
def _(spark, sf):
    la = landing(spark, sf).select("ts_code", "source", "value", "ordinal")
    pulls = dedup.union_pages([la.where(F.col("source") == s) for s in ("click", "view", "signup", "purchase", "error")])
    last = dedup.first_by(pulls, ["ts_code"], [F.col("page_no"), F.col("ordinal")], last=True)
    return last.select("ts_code", "source", "value", "ordinal")


_U3 = """& v AS (SELECT *, row_number() OVER (PARTITION BY ts_code, end_date{t}
     ORDER BY (update_flag = '1') DESC, ann_date DESC, ordinal) AS rn FROM reports)
"""


@query(
    "u3_version_pick",
    with_views(
        "reports",
        _U3.format(t=", report_type")
        + "SELECT ts_code, end_date, report_type, update_flag, ann_date, total_revenue FROM v WHERE rn = 1",
    ),
)
def _(spark, sf):
    return dedup.newest_version(reports(spark, sf)).select(
        "ts_code", "end_date", "report_type", "update_flag", "ann_date", "total_revenue"
    )


@query(
    "u3b_version_pick_untyped",
    with_views("reports", _U3.format(t="") + "SELECT ts_code, end_date, update_flag, ann_date, total_revenue FROM v WHERE rn = 1"),
)
def _(spark, sf):
    r = reports(spark, sf).drop("report_type")
    return dedup.newest_version(r, by_type=False).select("ts_code", "end_date", "update_flag", "ann_date", "total_revenue")


@query(
    "u3c_leftover_duplicates",
    with_views(
        "reports",
        _U3.format(t=", report_type")
        + """SELECT ts_code, end_date, 'merge_now' AS report_type, count(*) AS n_rows FROM v WHERE rn = 1
        GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
)
def _(spark, sf):
    merged = dedup.merge_types(dedup.newest_version(reports(spark, sf)))
    return dedup.key_conflicts(merged, ["ts_code", "end_date", "report_type"])


@query(
    "u4_minute_dedup",
    with_views(
        "landing",
        """SELECT ts_code, substr(trade_time, 1, 10) AS trade_time, value, ordinal FROM landing
        QUALIFY row_number() OVER (PARTITION BY ts_code, substr(trade_time, 1, 10) ORDER BY ordinal) = 1""",
    ),
)
def _(spark, sf):
    la = landing(spark, sf).select("ts_code", F.substring("trade_time", 1, 10).alias("trade_time"), "value", "ordinal")
    return dedup.first_by(la, dedup.minute_key("60m"), [F.col("ordinal")])


@query(
    "u4b_daily_dedup",
    with_views(
        "landing",
        """SELECT ts_code, trade_date, value, ordinal FROM landing
        QUALIFY row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY ordinal) = 1""",
    ),
)
def _(spark, sf):
    la = landing(spark, sf).select("ts_code", "trade_date", "value", "ordinal")
    return dedup.first_by(la, dedup.minute_key("1d"), [F.col("ordinal")])


PERIODS_SQL = f"per AS (SELECT date_key AS end_date FROM ({_PERIODS_SQL}))"


@query(
    "u5_missing_periods",
    with_views(
        "reports companies",
        f"""& {PERIODS_SQL}
        SELECT c.ts_code, per.end_date FROM companies c JOIN per ON per.end_date >= greatest('19960101', coalesce(c.list_date, ''))
        WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.ts_code = c.ts_code AND r.end_date = per.end_date)""",
    ),
)
def _(spark, sf):
    return jobs.report_check(companies(spark, sf), due_periods(spark, sf), reports(spark, sf), "19960101")


@query(
    "u6_missing_since_first",
    with_views(
        "reports companies",
        f"""& {PERIODS_SQL},
        f AS (SELECT ts_code, min(end_date) AS first FROM reports WHERE end_date BETWEEN '19960101' AND '20001231' GROUP BY 1)
        SELECT c.ts_code, per.end_date FROM companies c LEFT JOIN f USING (ts_code)
        JOIN per ON per.end_date >= greatest('19960101', coalesce(f.first, '19960101')) AND per.end_date <= '20001231'
        WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.ts_code = c.ts_code AND r.end_date = per.end_date)""",
    ),
)
def _(spark, sf):
    return jobs.missing_periods_since_first(companies(spark, sf), due_periods(spark, sf), reports(spark, sf), "19960101", "20001231")


@query(
    "u7_missing_months_per_index",
    with_views(
        "index_m",
        """& have AS (SELECT DISTINCT ts_code, substr(trade_date, 1, 6) AS month FROM index_m WHERE open > 25500),
        months AS (SELECT strftime(d, '%Y%m') AS month FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS d)),
        codes AS (SELECT unnest(['000300.SH', '000905.SH', '000852.SH', '399006.SZ']) AS ts_code)
        SELECT ts_code, month, month || '01' AS pull_start,
               strftime(last_day(strptime(month || '01', '%Y%m%d')), '%Y%m%d') AS pull_end
        FROM codes, months WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.ts_code = codes.ts_code AND h.month = months.month)""",
    ),
)
def _(spark, sf):
    from barloom.operators.index_gaps import missing_months

    have = index_m(spark, sf).where("open > 25500")
    return missing_months(["000300.SH", "000905.SH", "000852.SH", "399006.SZ"], have, spine.months(spark, "199501", "200112"))


@query(
    "u7b_missing_days_per_index",
    with_views(
        "index_m bars_m",
        """& have AS (SELECT ts_code, trade_date FROM index_m WHERE open > 25800),
        days AS (SELECT DISTINCT trade_date FROM bars_m), codes AS (SELECT unnest(['000300.SH', '000905.SH', '399006.SZ']) AS ts_code)
        SELECT c.ts_code, min(d.trade_date) AS first_missing, max(d.trade_date) AS last_missing, count(*) AS n_missing
        FROM codes c, days d WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.ts_code = c.ts_code AND h.trade_date = d.trade_date)
        GROUP BY 1""",
    ),
)
def _(spark, sf):
    from barloom.operators.index_gaps import missing_days

    have = index_m(spark, sf).where("open > 25800")
    return missing_days(["000300.SH", "000905.SH", "399006.SZ"], have, bars_m(spark, sf).select("trade_date").distinct())


_INDEX_SPAN = ("19950101", "20001231")
_INDEX_GAPS_SQL = """, have_d AS (SELECT DISTINCT ts_code AS index_code, trade_date AS date_key FROM bars_d WHERE vol > 20),
  codes_d AS (SELECT DISTINCT ts_code AS index_code FROM bars_d),
  days AS (SELECT DISTINCT cal_date AS date_key FROM calendar WHERE is_open = '1' AND cal_date BETWEEN '19950101' AND '20001231'),
  have_m AS (SELECT DISTINCT ts_code AS index_code, substr(trade_date, 1, 6) AS date_key FROM index_m WHERE open > 25500),
  codes_m AS (SELECT unnest(['000300.SH', '000905.SH', '000852.SH', '399006.SZ']) AS index_code),
  months AS (SELECT strftime(d, '%Y%m') AS date_key FROM (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2000-12-01', INTERVAL 1 MONTH)) AS d)),
  gone_d AS (SELECT index_code, date_key FROM (SELECT * FROM codes_d, days) ANTI JOIN have_d USING (index_code, date_key)),
  gone_m AS (SELECT index_code, date_key FROM (SELECT * FROM codes_m, months) ANTI JOIN have_m USING (index_code, date_key))
"""


def _index_sources(spark, sf):
    """A source pulled by day over all codes, and one by month over the default indices: (source, table, codes)."""
    from barloom.operators.index_gaps import IndexSource, codes_of

    daily = bars_d(spark, sf)
    by_day = IndexSource("index_daily", "day", "ts_code", start=_INDEX_SPAN[0])
    by_month = IndexSource("index_weight", "month", "ts_code")
    return (
        (by_day, daily.where("vol > 20"), daily.select(F.col("ts_code").alias("index_code"))),
        (by_month, index_m(spark, sf).where("open > 25500"), codes_of(spark)),
    )


@query(
    "u7c_index_pull_ranges",
    with_views(
        "bars_d calendar index_m",
        "&"
        + _INDEX_GAPS_SQL[1:]
        + """SELECT 'index_daily' AS source_name, index_code, min(date_key) AS pull_start, max(date_key) AS pull_end, count(*) AS n_missing FROM gone_d GROUP BY index_code
        UNION ALL SELECT 'index_weight', index_code, date_key || '01', strftime(last_day(strptime(date_key || '01', '%Y%m%d')), '%Y%m%d'), CAST(1 AS BIGINT) FROM gone_m""",
    ),
)
def _(spark, sf):
    from barloom.operators.index_gaps import pull_ranges

    days = calendar(spark, sf)
    day, month = [pull_ranges(s, t, codes, days, _INDEX_SPAN[1], _INDEX_SPAN[0]) for s, t, codes in _index_sources(spark, sf)]
    return day.unionByName(month)


@query(
    "u7d_index_coverage",
    with_views(
        "bars_d calendar index_m",
        "&"
        + _INDEX_GAPS_SQL[1:]
        + """, cov AS (
          SELECT 'index_daily' AS source_name, c.index_code, (SELECT count(*) FROM days) AS n_due, (SELECT max(date_key) FROM have_d h WHERE h.index_code = c.index_code) AS last_key,
            (SELECT count(*) FROM gone_d g WHERE g.index_code = c.index_code) AS gone FROM codes_d c
          UNION ALL SELECT 'index_weight', c.index_code, (SELECT count(*) FROM months), (SELECT max(date_key) FROM have_m h WHERE h.index_code = c.index_code),
            (SELECT count(*) FROM gone_m g WHERE g.index_code = c.index_code) FROM codes_m c)
        SELECT source_name, index_code, n_due, n_due - gone AS n_have, round((n_due - gone) / n_due, 8) AS rate, last_key FROM cov""",
    ),
)
def _(spark, sf):
    from barloom.operators.index_gaps import index_coverage

    days = calendar(spark, sf)
    day, month = [index_coverage(s, t, codes, days, _INDEX_SPAN[1], _INDEX_SPAN[0]) for s, t, codes in _index_sources(spark, sf)]
    return day.unionByName(month).withColumn("rate", F.round("rate", 8))


@query(
    "u8_missing_range_per_security",
    with_views(
        "listing bars_m",
        """& days AS (SELECT DISTINCT trade_date FROM bars_m)
        SELECT l.ts_code, min(d.trade_date) AS first_missing, max(d.trade_date) AS last_missing, count(*) AS n_missing
        FROM listing l JOIN days d ON d.trade_date >= l.list_date AND (coalesce(l.delist_date, '') = '' OR d.trade_date <= l.delist_date)
        WHERE l.list_date <> '' AND NOT EXISTS (SELECT 1 FROM bars_m b WHERE b.ts_code = l.ts_code AND b.trade_date = d.trade_date AND b.vol > 100)
        GROUP BY 1""",
    ),
)
def _(spark, sf):
    b = bars_m(spark, sf)
    have = b.where("vol > 100")
    return gaps.missing_spans(listing(spark, sf), b.select("trade_date"), have, keep_delist_day=True, need_list_date=True)


@query(
    "u9_resolved_days",
    with_views(
        "bars_d",
        """SELECT ts_code, count(*) AS n_days, array_to_string(list_sort(list(DISTINCT trade_date)), ',') AS days
        FROM bars_d WHERE adj_factor IS NOT NULL GROUP BY 1""",
    ),
)
def _(spark, sf):
    b = bars_d(spark, sf).where(F.col("adj_factor").isNotNull())
    found = daybits.listed(daybits.dated(b, "ts_code", "trade_date"), "ts_code")
    return found.select("ts_code", "n_days", F.array_join("days", ",").alias("days"))


_SEEN_SQL = """seen AS (SELECT DISTINCT ts_code, 'kline_daily' AS missing_entity, missing_date FROM
    (SELECT ts_code, missing_date FROM log WHERE try_count > 9 UNION ALL SELECT ts_code, missing_date FROM log WHERE try_count > 11
     UNION ALL SELECT ts_code, '20' || substr(missing_date, 3) FROM log WHERE try_count = 3 AND missing_date < '2'))"""


def _seen(log):
    again = log.where("try_count > 9").select("ts_code", "missing_entity", "missing_date")
    twice = log.where("try_count > 11").select("ts_code", "missing_entity", "missing_date")
    new = log.where("try_count = 3 AND missing_date < '2'").select(
        "ts_code", "missing_entity", F.concat(F.lit("20"), F.substring("missing_date", 3, 6)).alias("missing_date")
    )
    return again.unionByName(twice).unionByName(new)


@query(
    "u10_registry_upsert",
    f"""WITH {LOG_SQL}, {_SEEN_SQL}
    SELECT coalesce(l.ts_code, s.ts_code) AS ts_code, coalesce(l.missing_date, s.missing_date) AS missing_date,
      CAST(CASE WHEN s.ts_code IS NOT NULL THEN coalesce(l.try_count, 0) + 1 ELSE l.try_count END AS INTEGER) AS try_count,
      CASE WHEN s.ts_code IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS last_try_time
    FROM log l FULL JOIN seen s ON l.ts_code = s.ts_code AND l.missing_date = s.missing_date""",
)
def _(spark, sf):
    log = missing_log(spark, sf)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return registry.record_missing(log, _seen(log), at).select("ts_code", "missing_date", "try_count", "last_try_time")


@query(
    "u11_registry_delete",
    with_views(
        "bars_d",
        f"""& {LOG_SQL} SELECT ts_code, missing_date, try_count FROM log l WHERE NOT EXISTS
        (SELECT 1 FROM bars_d b WHERE b.ts_code = l.ts_code AND b.trade_date = l.missing_date AND b.vol > 30)""",
    ),
)
def _(spark, sf):
    done = bars_d(spark, sf).where("vol > 30").select(
        "ts_code", F.lit("kline_daily").alias("missing_entity"), F.col("trade_date").alias("missing_date")
    )
    return registry.forget_resolved(missing_log(spark, sf), done).select("ts_code", "missing_date", "try_count")


@query(
    "u12_hot_retention",
    with_views(
        "bars_m",
        "&" + FACTORS_SQL[1:]
        + """SELECT ts_code, trade_date, factor_name FROM factors
        WHERE trade_date >= (SELECT min(trade_date) FROM (SELECT DISTINCT trade_date FROM bars_m ORDER BY 1 DESC LIMIT 12))""",
    ),
)
def _(spark, sf):
    recent = hot_table.recent_dates(bars_m(spark, sf), 12)
    return hot_table.retain(factors_long(spark, sf), recent).select("ts_code", "trade_date", "factor_name")


@query(
    "u13_missing_codes_per_period",
    with_views(
        "reports companies",
        f"""& {PERIODS_SQL}
        SELECT l.ts_code, per.end_date FROM per JOIN companies l ON {LISTED_SQL.format(l='l', d='per.end_date')}
        WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.ts_code = l.ts_code AND r.end_date = per.end_date AND r.report_type IN ('1', '2'))""",
    ),
)
def _(spark, sf):
    known = companies(spark, sf).where(F.coalesce(F.col("list_date"), F.lit("")) != "")
    return gaps.missing_days(known, due_periods(spark, sf), reports(spark, sf).where("report_type IN ('1', '2')"), day="end_date")


@query(
    "u14_membership_union",
    with_views(
        "landing",
        """SELECT ts_code, l1, l2, l3, in_date, page_no, ordinal FROM (
          SELECT ts_code, source AS l1, substr(props, 7, 1) AS l2, CAST(floor(value) AS BIGINT) % 3 AS l3, trade_date AS in_date,
                 CAST(CASE WHEN source IN ('view', 'click') THEN 0 ELSE 1 END AS INTEGER) AS page_no, ordinal FROM landing)
        QUALIFY row_number() OVER (PARTITION BY ts_code, l1, l2, l3, in_date ORDER BY page_no, ordinal) = 1""",
    ),
)
def _(spark, sf):
    m = landing(spark, sf).select(
        "ts_code",
        F.col("source").alias("l1"),
        F.substring("props", 7, 1).alias("l2"),
        (F.floor("value").cast("long") % 3).alias("l3"),
        F.col("trade_date").alias("in_date"),
        "ordinal",
    )
    pulls = dedup.union_pages([m.where("l1 IN ('view', 'click')"), m.where("l1 NOT IN ('view', 'click')")])
    return dedup.first_by(pulls, ["ts_code", "l1", "l2", "l3", "in_date"], [F.col("page_no"), F.col("ordinal")])


@query(
    "u15_business_lines",
    """SELECT o_custkey AS ts_code, 'P' AS bz_type, o_orderpriority AS bz_item, round(sum(o_totalprice), 2) AS bz_sales FROM orders GROUP BY 1, 3
    UNION ALL SELECT o_custkey, 'D', n_name, round(sum(o_totalprice), 2) FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 3
    UNION ALL SELECT o_custkey, 'I', c_mktsegment, round(sum(o_totalprice), 2) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 3""",
)
def _(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    split = lambda df, kind, item: df.groupBy(F.col("o_custkey").alias("ts_code"), F.col(item).alias("bz_item")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("bz_sales")
    ).withColumn("bz_type", F.lit(kind))
    region = placed.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = split(o, "P", "o_orderpriority"), split(region, "D", "n_name"), split(placed, "I", "c_mktsegment")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
