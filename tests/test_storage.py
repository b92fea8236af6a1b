"""Scans, sinks and the incremental jobs on a store of their own."""

import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from barloom import session
from barloom.operators import factorset, filters
from barloom.plans import alphas, factors, hot_table, loads, panel
from barloom.session import scratch_path
from barloom.sources import bars as B
from barloom.sources import contracts, sinks


@pytest.fixture(scope="module")
def store(spark):
    rows = [(c, f"2024{m:02d}{d:02d}", float(m * 10 + d), None if d == 3 else 2.0) for c in ("A", "B") for m in (1, 2, 3) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, close double, adj_factor double")
    root = scratch_path(spark, "wh")
    sinks.write_bars(df, root)
    return root, B.BarStore(spark, root)


def test_months_and_ranges(store):
    _root, s = store
    assert [r.dt for r in s.months().collect()] == ["202401", "202402", "202403"]
    assert s.read_months(["202402"]).count() == 6
    with pytest.raises(ValueError):
        s.read_months([])
    r = s.read_range("20240102", "20240201", ["A"])
    assert sorted(x.trade_date for x in r.collect()) == ["20240102", "20240103", "20240201"]
    assert {x.trade_date: x.close_adj for x in r.collect()}["20240103"] == 13.0
    with pytest.raises(FileNotFoundError):
        s.read_range("20230101", "20230201")
    with pytest.raises(ValueError):
        s.read_range("20240201", "20240101")
    assert s.read_range("20240101", "20240331", []).isEmpty()
    assert s.read_month_with_window("202403", 0).count() == 6
    assert s.read_month_with_window("202403", 20).count() == 18


def test_scan_prunes_partitions_and_columns(store):
    _root, s = store
    plan = s.read_range("20240201", "20240210").select("ts_code", "close_adj")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "PushedFilters: [IsNotNull(trade_date)" in plan
    assert "ReadSchema: struct<ts_code:string,trade_date:string,close:double,adj_factor:double>" in plan


def test_overwrite_touches_only_its_partitions(spark, store):
    root = scratch_path(spark, "wh2")
    sinks.write_bars(store[1].table(), root)
    one = store[1].table().where("dt = '202402' and ts_code = 'A'")
    for _ in range(2):
        sinks.write_bars(one, root)
    got = {r.dt: r.n for r in B.BarStore(spark, root).table().groupBy("dt").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"202401": 6, "202402": 3, "202403": 6}


def test_factor_store(spark, store):
    root, s = store
    none = B.FactorStore(spark, scratch_path(spark, "none"))
    assert none.catalogue().isEmpty() and none.read("x", "20240101", "20240201").isEmpty()
    m = factors.Momentum(2)
    sinks.write_factors(factors.compute_month(m, s, "202402"), root)
    f = B.FactorStore(spark, root)
    assert f.read("momentum_2", "20240201", "20240228").count() == 6
    assert f.read("unknown", "20240201", "20240228").isEmpty()
    assert f.read("momentum_2", "20240228", "20240201").isEmpty()
    todo = factors.months_to_compute(s.months(), f.months("momentum_2"), "202401")
    assert sorted(r.dt for r in todo.collect()) == ["202401", "202403"]
    assert factors.months_to_compute(s.months(), f.months("momentum_2"), force=True).count() == 3


def test_hot_table_keeps_the_last_dates(spark, store):
    _root, s = store
    long = s.table().select("ts_code", "trade_date", F.lit("c").alias("factor_name"), F.col("close").alias("value"))
    h = hot_table.build(long.unionByName(long.withColumn("factor_name", F.lit("n")).withColumn("value", F.lit(float("nan")))), s.table(), ["c", "n"], 2)
    assert sorted((r.ts_code, r.trade_date, r.c, r.n) for r in h.collect()) == [(c, f"2024030{d}", 30.0 + d, None) for c in "AB" for d in (2, 3)]


def test_contract_projection(spark):
    rows = [("A", "20240101", "x"), ("B", "2024", "1.5"), ("C", "2024-01-05", "inf"), ("D", None, "1"), (" nan ", "20240102 09:30", "-2.5")]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, price string")
    got = contracts.conform(df, contracts.BLOCK_TRADE).collect()
    want = [("A", "20240101", None), ("C", "20240105", None), ("", "20240102", -2.5)]
    assert [tuple(r) for r in got] == [(c, d, "", "", p, None, None) for c, d, p in want]


CLOSES = contracts.Contract("closes", ("ts_code", "trade_date"), "ts_code string, trade_date string, close double")


def test_load_into_a_stored_table(spark):
    path, cols = scratch_path(spark, "closes"), "ts_code string, trade_date string, close double"
    counts = lambda rows: {r.diff_class: r.n_rows for r in loads.load_into(path, spark.createDataFrame(rows, cols), CLOSES).collect()}
    stored = lambda: sorted(map(tuple, loads.read_stored(spark, path, CLOSES).collect()))
    assert counts([("A", "2024-01-02", 1.0), ("A", "20240201", 2.0)]) == {"insert": 2}
    change = [("A", "20240102", 1.5), ("B", "20240103", None), ("A", "20240201", 2.0), ("C", "bad", 1.0)]
    assert counts(change) == {"update": 1, "insert": 1, "skip": 1}
    want = [("A", "20240102", 1.5, "202401"), ("A", "20240201", 2.0, "202402"), ("B", "20240103", None, "202401")]
    assert stored() == want
    assert counts(change) == {"skip": 3} and stored() == want
    with pytest.raises(ValueError, match="more than one row"):
        counts([("A", "20240102", 1.0), ("A", "2024-01-02", 2.0)])
    assert loads.load_into(path, spark.createDataFrame(stored(), cols + ", dt string"), CLOSES).collect()[0].diff_class == "skip"


def test_load_into_reads_its_months_and_joins_once(spark, monkeypatch):
    path, cols = scratch_path(spark, "closes"), "ts_code string, trade_date string, close double"
    load = lambda rows, *only: loads.load_into(path, spark.createDataFrame(rows, cols), CLOSES, *only)
    load([("A", "20240102", 1.0), ("A", "20240103", 2.0), ("B", "20240201", 3.0)])
    seen, merged = [], loads.merge.merged

    def spy(stored, *args):
        seen.append(stored.count())
        return merged(stored, *args)

    monkeypatch.setattr(loads.merge, "merged", spy)
    n = {r.diff_class: r.n_rows for r in load([("A", "20240102", 1.0 + 1e-12), ("", "20240103", 4.0), ("A", "20240103", None)]).collect()}
    assert seen == [2] and n == {"skip": 1, "insert": 1, "update": 1}
    got = sorted((r.ts_code or "", r.trade_date, r.close) for r in loads.read_stored(spark, path, CLOSES).collect())
    assert got == [("", "20240103", 4.0), ("A", "20240102", 1.0), ("A", "20240103", None), ("B", "20240201", 3.0)]
    with pytest.raises(ValueError, match="20240103"):
        load([("A", "20240103", 1.0), ("A", "20240103", 1.0)])
    assert loads.read_stored(spark, path, CLOSES).count() == 4


def test_report_types_of_one_period_are_an_error(spark):
    firms = spark.createDataFrame([("A", "20000101", None)], "ts_code string, list_date string, delist_date string")
    rows = [("A", "20231231", "20240401", "20240301", "1", "1", 1), ("A", "20231231", "20240301", "20240501", "1", "1", 2)]
    cols = "ts_code string, end_date string, f_ann_date string, ann_date string, report_type string, update_flag string, ordinal long"
    got = loads.newest_reports(spark.createDataFrame(rows, cols), firms).collect()
    assert [(r.f_ann_date, r.report_type) for r in got] == [("20240401", "merge_now")]
    with pytest.raises(ValueError, match="more than one row"):
        loads.newest_reports(spark.createDataFrame([rows[0], (*rows[1][:4], "4", "1", 2)], cols), firms)


def test_slices_are_what_was_asked(spark):
    df = spark.range(25_000).select(F.lit("20240101").alias("trade_date"), F.col("id").cast("string").alias("ts_code"))
    assert filters.table_slice(df, 24_000, ["ts_code"]).count() == 24_000
    with pytest.raises(ValueError):
        filters.table_slice(df, 0, ["ts_code"])


def test_no_machine_local_folder_off_a_local_master(spark, monkeypatch):
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Session)


def test_length_check(spark):
    df = spark.createDataFrame([("abc", "x"), ("a", "y")], "a string, b string")
    assert contracts.require_lengths(df, {"a": 3, "b": 1}) is df
    with pytest.raises(ValueError, match="a 3>2"):
        contracts.require_lengths(df, {"a": 2, "b": 1})


def test_no_index_gives_null_columns(spark, store):
    p = panel.build(store[1].table())
    assert p.where("benchmark_close is not null").isEmpty()
    assert B.index_scan(spark, None, "x").isEmpty()
    assert B.index_scan(spark, scratch_path(spark, "absent"), "x").isEmpty()


def test_bad_alpha_text_is_an_error(store):
    with pytest.raises(Exception):
        alphas.compute(panel.build(store[1].table()), [alphas.from_text("bad", "no_such_column + 1")]).count()


def test_wide_and_long_are_inverse(spark):
    rows = [("A", "d1", "f", 1.0), ("A", "d1", "g", 2.0), ("B", "d1", "g", 3.0)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, factor_name string, value double")
    back = factorset.long(factorset.wide(df, ["f", "g"]), ["f", "g"])
    assert sorted(map(tuple, back.select("ts_code", "trade_date", "factor_name", "value").collect())) == rows
    assert [r.ts_code for r in factorset.cross_section(df, ["f", "g"]).collect()] == ["A"]


def test_staged_tables_go_with_the_application(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "from barloom.session import stage\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', sys.argv[2]).getOrCreate()\n"
        "assert stage(spark.range(3)).count() == 3\n"
        "import os; assert any(d.startswith('barloom-') for d in os.listdir(sys.argv[2]))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code, root, str(tmp_path)], check=True, timeout=120)
    left = lambda: [d for d in os.listdir(tmp_path) if d.startswith("barloom-")]
    for _ in range(100):  # the JVM ends a moment after Python
        if not left():
            break
        time.sleep(0.2)
    assert not left()


def test_a_factor_is_read_from_its_own_row_groups(spark):
    names = [f"factor_{i:02d}" for i in range(40)]
    rows = spark.range(40 * 5_000).selectExpr(
        "concat('factor_', lpad(cast(id % 40 as string), 2, '0')) factor_name", "concat('c', lpad(cast(id div 40 as string), 5, '0')) ts_code",
        "concat('2024', lpad(cast(id % 3 + 1 as string), 2, '0'), '15') trade_date", "cast(hash(id) as double) value",
    )
    root = scratch_path(spark, "clustered")
    sinks.write_factors(rows, root, row_group_bytes=str(64 * 1024))
    store = B.FactorStore(spark, root)
    assert store.table().select("dt").distinct().count() == 3 and store.catalogue().count() == 40

    def rows_scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))

    everything = rows_scanned(store.table().where("value is not null"))
    one = rows_scanned(store.read("factor_17", "20240101", "20240331"))
    assert everything == 200_000 and 5_000 <= one <= 40_000
    again = rows.where(F.col("factor_name") == names[3]).withColumn("value", F.lit(1.5))
    sinks.write_factors(again.where("trade_date like '202402%'"), root)
    assert store.read(names[3], "20240201", "20240229").select("value").distinct().collect()[0].value == 1.5
    assert store.table().count() == 200_000
    before = {tuple(r) for r in rows.where(F.col("factor_name") == names[4]).select("ts_code", "trade_date", "value").collect()}
    assert {tuple(r) for r in store.read(names[4], "20240101", "20240331").collect()} == before
