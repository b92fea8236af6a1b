"""Factor metadata from three origins, and what index series lack, against plain versions."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import index_gaps
from barloom.plans import factor_meta, factors


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def stored_meta(spark, formulas):
    blank = (None,) * 5
    return spark.createDataFrame([(n, None, "kept", None, f, None, None, *blank[:2], 7) for n, f in formulas], factor_meta.STORED)


def test_origins(spark):
    registered = factor_meta.from_registered(spark, [factors.Momentum(20)])
    assert rows(registered) == [("momentum_20", "momentum_20", "自研", "技术", "{'adj_convention': 'hfq'}", "python", "barloom/plans/factors.py")]
    wide = spark.createDataFrame([], "ts_code string, trade_date string, pe double, ma_hfq_5 double, updays int, momentum_20 double")
    vendor = factor_meta.from_vendor(wide, {"pe": "P/E -price - earnings", "updays": " days up "}, source="v")
    assert [r[:5] for r in rows(vendor)] == [
        ("ma_5", "ma_5", "v", "技术", "ma_hfq_5｜ma_hfq_5"),
        ("momentum_20", "momentum_20", "v", "技术", "momentum_20｜momentum_20"),
        ("pe", "P/E", "v", "基本面", "pe｜price - earnings"),
        ("up_streak", "days up", "v", "统计", "updays｜days up"),
    ]
    stored = stored_meta(spark, [("a2", "mine"), ("a3", ""), ("a4", None), ("gone", "g"), ("a4", "x"), ("a4", "y")])
    formulas = [("a1", 1, "f", None), ("a2", 2, "f", "r"), ("a3", 3, "f", "r"), ("a4", 4, "", "r"), ("pe", 5, "f", ""), ("a6", 6, None, "r"), (None, 7, "f", None)]
    catalogue = factor_meta.from_catalogue(spark.createDataFrame(formulas, "factor_name string, number int, formula string, skip_reason string"), stored)
    assert {r.factor_name: r.formula for r in catalogue.collect()} == {"a1": "f", "a2": "mine", "a3": "f｜[r]", "a4": "y", "pe": "f", "a6": "r", None: "f"}

    entries = factor_meta.first_named(registered, vendor, catalogue)
    assert {r.factor_name: r.source for r in entries.collect()} == {
        "momentum_20": "自研", "ma_5": "v", "pe": "v", "up_streak": "v", "a1": "catalogue", "a2": "catalogue", "a3": "catalogue", "a4": "catalogue", "a6": "catalogue",
    }
    coverage = spark.createDataFrame([("pe", "20200102", "20210301", 15), ("a1", "20200102", "20200102", 1)], "factor_name string, start_date string, end_date string, month_count long")
    kept = stored.where("factor_name IN ('a2', 'gone')")
    after = {r.factor_name: r for r in factor_meta.refreshed(kept, entries, coverage).collect()}
    assert len(after) == 10 and (after["gone"].formula, after["gone"].month_count) == ("g", 7)
    assert after["pe"][-3:] == ("20200102", "20210301", 15) and after["a2"][-3:] == (None, None, 0)
    # A second refresh changes nothing.
    again = factor_meta.refreshed(factor_meta.refreshed(kept, entries, coverage), entries, coverage)
    assert rows(again) == rows(factor_meta.refreshed(kept, entries, coverage))
    assert rows(factor_meta.by_source(again)) == [("catalogue", 5, 1), ("kept", 1, 0), ("v", 3, 1), ("自研", 1, 0)]


def test_no_factors_at_all(spark):
    empty = stored_meta(spark, []), spark.createDataFrame([], "factor_name string, number int, formula string, skip_reason string")
    entries = factor_meta.first_named(factor_meta.from_registered(spark, []), factor_meta.from_catalogue(empty[1], empty[0]))
    coverage = spark.createDataFrame([], "factor_name string, start_date string, end_date string, month_count long")
    assert factor_meta.refreshed(empty[0], entries, coverage).count() == 0


DAYS = [(date(2023, 12, 20) + timedelta(n)).strftime("%Y%m%d") for n in range(100)]
OPENS = [d for n, d in enumerate(DAYS) if n % 7 < 5]


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([("SSE", d, "1" if d in OPENS else "0") for d in DAYS], "exchange string, cal_date string, is_open string")


@pytest.mark.parametrize("unit", ["day", "month"])
@pytest.mark.parametrize("seed", [1, 2])
def test_pull_ranges_and_coverage(spark, calendar, unit, seed):
    rng = random.Random(seed)
    codes = ["i1", "i2", "i3", "whole"]
    made = [(rng.choice(codes), rng.choice(OPENS)) for _ in range(90 if unit == "day" else 3)] + [("whole", d) for d in OPENS] + [(None, OPENS[0]), ("i1", None), ("other", OPENS[3])]
    dashed = [(c and f" {c} ", d and rng.choice([d, f"{d[:4]}-{d[4:6]}-{d[6:]}"]), 1.0) for c, d in made]
    table = spark.createDataFrame(dashed, "index_code string, trade_date string, n_missing double")
    listed = spark.createDataFrame([(c,) for c in [*codes, "i1", "never", "", None]], "index_code string")
    source = index_gaps.IndexSource("s", unit, start="20240101")
    end = "20240229"
    cut = 8 if unit == "day" else 6
    due = [d for d in OPENS if "20240101" <= d <= end] if unit == "day" else ["202401", "202402"]
    ranges, coverage = [], []
    for c in [*codes, "never"]:
        have = {d[:cut] for x, d in made if x == c and d}
        gone = [k for k in due if k not in have]
        if unit == "day" and gone:
            ranges.append(("s", c, gone[0], gone[-1], len(gone)))
        if unit == "month":
            ranges += [("s", c, f"{k}01", {"202401": "20240131", "202402": "20240229"}[k], 1) for k in gone]
        coverage.append(("s", c, len(due), len(due) - len(gone), (len(due) - len(gone)) / len(due), max(have, default=None)))
    assert rows(index_gaps.pull_ranges(source, table, listed, calendar, end)) == sorted(ranges, key=str)
    assert rows(index_gaps.index_coverage(source, table, listed, calendar, end)) == sorted(coverage, key=str)
    # Nothing is stored: all is missing. Nothing is asked for: nothing is missing.
    bare = table.where("false")
    assert index_gaps.pull_ranges(source, bare, listed, calendar, end).agg(F.sum("n_missing")).first()[0] == 5 * len(due)
    assert index_gaps.pull_ranges(source, bare, listed, calendar, "20231231").count() == 0
    assert index_gaps.pull_ranges(source, bare, listed.where("false"), calendar, end).count() == 0


def test_default_indices_and_units(spark):
    assert {r[0] for r in index_gaps.codes_of(spark).collect()} == set(index_gaps.DEFAULT_CODES)
    with pytest.raises(ValueError):
        index_gaps.IndexSource("s", "week")
