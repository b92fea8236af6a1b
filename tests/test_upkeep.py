"""Snapshots kept up by loads against snapshots counted anew; loads with null and doubled keys."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import merge
from barloom.plans import upkeep

KEYS = ["ts_code", "trade_date"]
SHAPE = "ts_code string, trade_date string, vol double"
SNAPSHOT = "source_name string, date_key string, period_stock_count long, resolved_count long"


@pytest.fixture(scope="module")
def market(spark):
    codes = [(f"600{i:03d}.SH", "SSE", "", f"2024010{i % 5 + 1}", "20240105" if i == 3 else "") for i in range(6)]
    listing = spark.createDataFrame(codes, "ts_code string, exchange string, name string, list_date string, delist_date string")
    calendar = spark.createDataFrame([("SSE", f"2024010{d}", "1" if d != 6 else "0") for d in range(1, 9)], "exchange string, cal_date string, is_open string")
    periods = spark.createDataFrame([("20231231",), ("20240331",), ("20241231",)], "end_date string")
    suspend = spark.createDataFrame([("600000.SH", "20240104", "S", None)], "ts_code string, trade_date string, suspend_type string, suspend_timing string")
    return upkeep.Market(listing, calendar, periods, suspend)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rules(spark, market):
    count = lambda rule, **more: dict(rows(upkeep.expected_counts(upkeep.Source("s", "d", rule, **more), market, "20240101", "20241231")))
    open_days = [f"2024010{d}" for d in (1, 2, 3, 4, 5, 7, 8)]
    assert count("indices", indices=("a", "b")) == dict.fromkeys(open_days, 2)
    assert count("event") == dict.fromkeys(open_days, 1)
    # Codes 0 and 5 are listed on the 1st, then one more a day; code 3 is listed on the 4th and goes on the 5th.
    assert count("trading") == {"20240101": 2, "20240102": 3, "20240103": 4, "20240104": 4, "20240105": 5, "20240107": 5, "20240108": 5}
    assert count("listed") == {"20240331": 5, "20241231": 5} and count("listed", annual=True) == {"20241231": 5}
    stored = spark.createDataFrame([("20240331", 9, 9), ("20241231", 0, 0)], "date_key string, listed_count long, trading_count long")
    held = upkeep.Market(market.listing, market.calendar, market.periods, market.suspend, stored)
    assert dict(rows(upkeep.expected_counts(upkeep.Source("s", "d", "listed"), held, "20240101", "20241231"))) == {"20240331": 9, "20241231": 5}
    with pytest.raises(ValueError):
        upkeep.Source("s", "d", "indices")
    with pytest.raises(ValueError):
        upkeep.Source("s", "d", "other")


@pytest.mark.parametrize("seed", [1, 2])
def test_upkeep_is_a_recount(spark, market, seed):
    rng = random.Random(seed)
    sources = [upkeep.Source("bars", "trade_date"), upkeep.Source("large", "trade_date", counts=F.col("vol") > 5), upkeep.Source("one", "trade_date", "indices", indices=("x",))]
    span = ("20240101", "20240108")
    table = spark.createDataFrame([], SHAPE)
    kept = upkeep.recounted(sources[0], table, market, *span).where("false")
    for s in sources:
        kept = kept.unionByName(upkeep.recounted(s, table, market, *span))
    for _ in range(3):
        made = {(rng.choice(["600000.SH", "600001.SH", "", None]), rng.choice(["20240101", "2024-01-02", "20240103", "20240104", "20240106", None])) for _ in range(9)}
        made = {((c or ""), d): (c, d) for c, d in made}.values()
        incoming = spark.createDataFrame([(c, d, rng.choice([None, 1.0, 9.0])) for c, d in made], SHAPE)
        gone = table.where(F.rand(seed) < 0.3).select(*KEYS)
        gone = spark.createDataFrame(gone.collect(), "ts_code string, trade_date string")
        classified = merge.classify(incoming, table, KEYS)
        changes = upkeep.count_changes(upkeep.signed_changes(classified, table, KEYS, gone), sources)
        kept = upkeep.kept_up(kept, changes, upkeep.all_expected(sources, market, *span))
        after = merge.upsert(merge.join_keys(table, gone, KEYS, "left_anti"), incoming, KEYS)
        table = spark.createDataFrame(after.collect(), SHAPE)
        kept = spark.createDataFrame(kept.collect(), SNAPSHOT)
        again = [r for s in sources for r in rows(upkeep.recounted(s, table, market, *span))]
        assert rows(kept) == sorted(again)


def test_events_keep_their_marks(spark, market):
    source = upkeep.Source("events", "trade_date", "event")
    before = spark.createDataFrame([("events", "20240101", 1, 1), ("events", "20240102", 1, 0), ("events", "20240103", 1, 2), ("x", "20240101", 3, 3)], SNAPSHOT)
    table = spark.createDataFrame([("a", "20240102", 1.0), ("b", "20240102", 1.0)], SHAPE)
    changes = spark.createDataFrame([("events", "20240102", 2), ("events", "20240103", -2)], "source_name string, date_key string, change long")
    got = rows(upkeep.events_kept_up(before, source, table, changes))
    assert got == [("events", "20240101", 1, 1), ("events", "20240102", 1, 2), ("events", "20240103", 1, 1), ("x", "20240101", 3, 3)]


def test_null_keys_are_blank_keys(spark):
    t = spark.createDataFrame([("a", None, 1.0), (None, "20240101", 2.0), ("b", "", 3.0)], SHAPE)
    assert [r.diff_class for r in merge.classify(t, t, KEYS).collect()] == ["skip"] * 3
    new = spark.createDataFrame([("a", "", 5.0), ("b", None, 3.0), ("c", None, 1.0)], SHAPE)
    assert sorted((r.ts_code, r.diff_class) for r in merge.classify(new, t, KEYS).collect()) == [("a", "update"), ("b", "skip"), ("c", "insert")]
    got = sorted((r.ts_code or "", r.trade_date, r.vol) for r in merge.upsert(t, new, KEYS).collect())
    assert got == [("", "20240101", 2.0), ("a", None, 5.0), ("b", "", 3.0), ("c", None, 1.0)]


def test_doubled_incoming_keys_do_not_multiply_rows(spark):
    t = spark.createDataFrame([("a", "d", 1.0)], SHAPE)
    new = spark.createDataFrame([("a", "d", 5.0), ("a", "d", 7.0), ("b", "d", 2.0), ("b", "d", 2.0)], SHAPE)
    assert rows(merge.upsert(t, new, KEYS)) == [("a", "d", 7.0), ("b", "d", 2.0)]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"a":1,"b":{"c":[1,2],"d":null}}', ' { "b": {"d":null, "c":[1, 2]}, "a":1}', True),
        ('{"a":1}', '{"a":"1"}', False),
        ('{"a":[1,2]}', '{"a":[2,1]}', False),
        ('{"a":{"b":{"c":1}}}', '{"a":{"b":{"c":2}}}', False),
        ("no json", "no json", True),
        ("no json", "no json at all", False),
        (None, None, True),
        ("{}", None, False),
    ],
)
def test_documents_are_compared_as_documents(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(merge.canonical_json(F.col("a")).eqNullSafe(merge.canonical_json(F.col("b"))).alias("s")).first().s == same
