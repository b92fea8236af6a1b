"""Hand-checked cases of calendars, listings, loads and completeness."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars, text
from barloom.operators import completeness, dedup, gaps, merge, nested, registry, series, spine, universe


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return row.select(expr.alias("v")).first().v


def test_report_periods(spark):
    assert values(spine.report_periods(spark, "20040101", "20050401"), "end_date") == [("20040630",), ("20041231",), ("20050331",)]
    assert spine.report_periods(spark, "2006", "2005").isEmpty()


def test_spines(spark):
    assert [r.month for r in spine.months(spark, "202311", "202402").collect()] == ["202311", "202312", "202401", "202402"]
    assert len(spine.calendar_days(spark, "20240227", "20240301").collect()) == 4


def test_gap_merge(spark):
    days = spark.createDataFrame([(f"d{i}",) for i in range(1, 7)], "trade_date string")
    missing = spark.createDataFrame([("A", d) for d in ("d2", "d3", "d5")], "ts_code string, trade_date string")
    assert values(gaps.merge_consecutive(missing, days), "gap_start", "gap_end") == [("d2", "d3"), ("d5", "d5")]


def test_listed_on_the_listing_day_not_on_the_delisting_day(spark):
    on = universe.listed_on(F.lit("20240105"), F.col("l"), F.col("d"))
    assert one(spark, on, l="20240105", d="") is True
    assert one(spark, on, l="20240101", d="20240105") is False
    assert one(spark, on, l="20240101", d="20240106") is True
    assert one(spark, on, l="", d="") is False
    keep = universe.listed_on(F.lit("20240105"), F.col("l"), F.col("d"), keep_delist_day=True)
    assert one(spark, keep, l="20240101", d="20240105") is True


def test_nearest_open(spark):
    opens = spark.createDataFrame([("20240105",), ("20240108",)], "trade_date string")
    keys = spark.createDataFrame([("20240107",), ("20240104",), ("20240108",)], "day string")
    got = {r.day: r.open_date for r in spine.nearest_open(keys, "day", opens).collect()}
    assert got == {"20240107": "20240105", "20240104": None, "20240108": "20240108"}


def test_version_pick(spark):
    rows = [("A", "20231231", "1", "0", "20240501", 1), ("A", "20231231", "1", "1", "20240430", 2), ("A", "20231231", "1", "1", "20240428", 3)]
    df = spark.createDataFrame(rows, "ts_code string, end_date string, report_type string, update_flag string, ann_date string, ordinal long")
    assert values(dedup.newest_version(df), "update_flag", "ann_date") == [("1", "20240430")]


def test_keep_first_follows_the_page_order_not_the_row_order(spark):
    schema = "ts_code string, trade_date string, v int, ordinal int"
    a, b = spark.createDataFrame([("A", "d", 1, 9)], schema), spark.createDataFrame([("A", "d", 2, 1)], schema)
    pages = dedup.union_pages([a, b])
    order = [F.col("page_no"), F.col("ordinal")]
    assert dedup.first_by(pages, ["ts_code", "trade_date"], order).first().v == 1
    assert dedup.first_by(pages, ["ts_code", "trade_date"], order, last=True).first().v == 2


def test_sticky_snapshot(spark):
    keys = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "date_key string")
    actual = spark.createDataFrame([("d3", 4)], "date_key string, resolved_count long")
    prev = spark.createDataFrame([("s", "d1", 1, 1), ("s", "d2", 1, 0), ("other", "d2", 1, 1)], "source_name string, date_key string, period_stock_count long, resolved_count long")
    got = values(completeness.sticky_snapshot("s", keys, actual, prev), "date_key", "resolved_count")
    assert got == [("d1", 1), ("d2", 0), ("d3", 4)]
    marked = completeness.mark_pulled(prev, "s", keys.where("date_key = 'd2'"))
    assert ("s", "d2", 1) in values(marked, "source_name", "date_key", "resolved_count")


def test_diff_classes(spark):
    old = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, "x"), ("c", 1.0, "x"), ("d", float("nan"), "")], "k string, v double, t string")
    new = spark.createDataFrame([("a", 1.0 + 5e-10, ""), ("b", 1.1, "x"), ("c", 1.0, "x"), ("d", None, None), ("e", 1.0, "x")], "k string, v double, t string")
    got = dict(values(merge.classify(new, old, ["k"]), "k", "diff_class"))
    assert got == {"a": "skip", "b": "update", "c": "skip", "d": "skip", "e": "insert"}
    scoped = dict(values(merge.classify(new, old, ["k"], in_scope=F.col("k") != "e"), "k", "diff_class"))
    assert scoped["e"] == "skip"


def test_json_compared_without_key_order(spark):
    old = spark.createDataFrame([("a", '{"x":1,"y":2}'), ("b", '{"x":1}')], "k string, j string")
    new = spark.createDataFrame([("a", '{"y": 2, "x": 1}'), ("b", '{"x":2}')], "k string, j string")
    got = dict(values(merge.classify(new, old, ["k"], json_columns=("j",)), "k", "diff_class"))
    assert got == {"a": "skip", "b": "update"}


def test_registry_counts_on(spark):
    log = spark.createDataFrame([("A", "kline_daily", "d1", 2, None)], "ts_code string, missing_entity string, missing_date string, try_count int, last_try_time timestamp_ntz")
    seen = spark.createDataFrame([("A", "kline_daily", "d1"), ("A", "kline_daily", "d1"), ("B", "kline_daily", "d2"), ("", "kline_daily", "d2")], "ts_code string, missing_entity string, missing_date string")
    out = registry.record_missing(log, seen, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert values(out, "ts_code", "try_count") == [("A", 3), ("B", 1)]
    assert values(registry.forget_resolved(out, seen.where("ts_code = 'A'")), "ts_code") == [("B",)]


def test_text_normalisers(spark):
    assert one(spark, text.date_key(F.col("s")), s="2024-01-05 x") == "20240105"
    assert one(spark, text.date_key(F.col("s")), s="2024-1") == ""
    assert one(spark, text.date_digits(F.col("s")), s="2024/01/05 10:00") == "20240105"
    assert one(spark, text.date_digits(F.col("s")), s="2024/1") is None
    assert one(spark, text.blank_text(F.col("s")), s=" NaN ") == ""
    assert one(spark, text.number(F.col("s")), s="1.5x") is None
    assert one(spark, text.time_key(F.col("s")), s="2024-01-05 10:30:00.5") == "20240105103000"


def test_code_classes(spark):
    for c, want in (("900901.SH", True), ("200012.SZ", True), ("600000.SH", False)):
        assert one(spark, scalars.is_b_share(F.col("c")), c=c) is want
    assert one(spark, scalars.board(F.col("c")), c="688001.SH") == "科创板(688)"
    assert one(spark, scalars.board(F.col("c")), c="510300.SH") == "沪其他(510)"
    assert one(spark, scalars.board(F.col("c")), c="00700.HK") == "HK其他"
    assert one(spark, scalars.board(F.col("c")), c="x") == "未知"
    assert scalars.vendor_name("ma_hfq_5") == "ma_5" and scalars.vendor_name("close_hfq") == "close"
    assert scalars.vendor_name("updays") == "up_streak" and scalars.vendor_name("pe") == "pe"


def test_prices_and_limits(spark):
    adj = scalars.adjusted(F.col("p"), F.col("a"))
    assert one(spark, adj, p=10.0, a=2.0) == 20.0
    assert spark.range(1).select(scalars.adjusted(F.lit(10.0), F.lit(None).cast("double"))).first()[0] == 10.0
    assert one(spark, scalars.vwap(F.col("m"), F.col("v")), m=50.0, v=100.0) == 5.0
    assert one(spark, scalars.vwap(F.col("m"), F.col("v")), m=50.0, v=0.0) is None
    hit = scalars.limit_hit(F.col("c"), F.col("u"), F.col("d"))
    assert one(spark, hit, c=10.99, u=11.0, d=9.0) is True
    assert one(spark, hit, c=9.5, u=11.0, d=9.0) is False


def test_return_metrics(spark):
    df = spark.createDataFrame([("d1", 0.1), ("d2", -0.2), ("d3", 0.05)], "trade_date string, r double")
    m = series.return_metrics(df, "r").first()
    assert m.n_days == 3 and m.mdd == pytest.approx(-0.2)
    assert m.annual_return == pytest.approx(0.924 ** (252 / 3) - 1)
    assert series.nav(df, "r").orderBy(F.desc("trade_date")).first().nav == pytest.approx(0.924)
    flat = series.return_metrics(df.withColumn("r", F.lit(0.0)), "r").first()
    assert flat.sharpe is None and flat.calmar is None and flat.mdd == 0.0


def test_benchmark_nav_base(spark):
    dates = spark.createDataFrame([("d2",), ("d3",), ("d4",)], "trade_date string")
    before = spark.createDataFrame([("d1", 2.0), ("d3", 4.0)], "trade_date string, close double")
    assert [v for _d, v in values(series.benchmark_nav(dates, before), "trade_date", "value")] == [1.0, 2.0, 2.0]
    later = spark.createDataFrame([("d3", 4.0), ("d4", 5.0)], "trade_date string, close double")
    assert [v for _d, v in values(series.benchmark_nav(dates, later), "trade_date", "value")] == [1.0, 1.0, 1.25]
    assert series.benchmark_nav(dates, later.where("close > 9")).isEmpty()


def test_three_threshold_tests_differ(spark):
    df = spark.createDataFrame([("d1", 7, 6), ("d2", 7, 5), ("d3", 0, 0)], "date_key string, period_stock_count long, resolved_count long")
    m = completeness.macro_scan(df, "resolved_count", "period_stock_count").first()
    assert (m.pass_days, m.fail_days, m.missing_records, m.active_stock) == (1, 1, 1, 0)
    assert values(completeness.below_ratio(df), "date_key") == [("d1",), ("d2",)]
    assert values(completeness.below_share(df, "resolved_count", "period_stock_count"), "date_key") == [("d1",), ("d2",)]


def test_freshness(spark):
    f = completeness.freshness(F.col("a"), F.lit("20240110"))
    got = [spark.range(1).select(F.lit(d).alias("a")).select(f["status"].alias("s")).first().s for d in ("20240109", "20240107", "20240106")]
    assert got == ["ok", "warning", "critical"]


def test_overflow_packing(spark):
    df = spark.createDataFrame([("A", 1, float("nan"), " ", None, "y")], "ts_code string, n int, f double, b string, z string, t string")
    assert nested.pack_overflow(df, ["ts_code"], "doc").first().doc == '{"n":1,"t":"y"}'


def test_reconciliation(spark):
    left = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("m3",), ("m5",)], "m string")
    right = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("m2",), ("m4",)], "m string")
    skip = spark.createDataFrame([("m5",)], "m string")
    assert dict(values(merge.reconcile_counts(left, right, "m", skip), "m", "status")) == {
        "m1": "ok", "m2": "diff", "m3": "left_only", "m4": "right_only", "m5": "expected_skip",
    }


def test_listed_sweep_matches_the_predicate(spark):
    rows = [("600001.SH", "d2", ""), ("600002.SH", "d1", "d3"), ("900901.SH", "d1", ""), ("600003.SH", "", ""), ("600004.SH", "d3", "d2")]
    li = spark.createDataFrame(rows, "ts_code string, list_date string, delist_date string")
    days = spark.createDataFrame([(f"d{i}",) for i in range(5)], "date_key string")
    assert dict(values(universe.listed_counts(li, days), "date_key", "listed_count")) == {"d0": 0, "d1": 1, "d2": 2, "d3": 1, "d4": 1}
