"""Order inside a cross-section, with the group in one task and cut into buckets."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import ordering, portfolio, xsection

SIZES = [10_000_000, 7]  # rows per task: one task, and cut


@pytest.fixture(scope="module")
def hot(spark):
    """One date with most of the rows, a third of them with one value, and a few nulls."""
    rnd = random.Random(5)
    rows = [("d1", f"c{i:04d}", None if i % 29 == 0 else (5.0 if i % 3 == 0 else round(rnd.uniform(0, 20), 1))) for i in range(600)]
    rows += [("d2", f"c{i:04d}", float(i)) for i in range(5)] + [("d3", "c0000", 1.0)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "trade_date string, ts_code string, x double").repartition(5)


def by_date(rows):
    out = {}
    for d, c, x in rows:
        out.setdefault(d, []).append((c, x))
    return out


@pytest.mark.parametrize("size", SIZES)
def test_positions(hot, size):
    rows, df = hot
    got = {(r.trade_date, r.ts_code): r.position for r in ordering.positions(df.where("x is not null"), ["trade_date"], [-F.col("x"), F.col("ts_code")], rows_per_task=size).collect()}
    want = {}
    for d, xs in by_date(rows).items():
        for i, (c, _x) in enumerate(sorted([p for p in xs if p[1] is not None], key=lambda p: (-p[1], p[0])), 1):
            want[d, c] = i
    assert got == want


@pytest.mark.parametrize("size", SIZES)
def test_average_rank(hot, size):
    rows, df = hot
    got = {(r.trade_date, r.ts_code): r.r for r in ordering.average_rank(df, "x", ["trade_date"], "r", share=True, rows_per_task=size).collect()}
    assert len(got) == len(rows)
    for d, xs in by_date(rows).items():
        vals = [x for _c, x in xs if x is not None]
        for c, x in xs:
            want = None if x is None else (sum(v < x for v in vals) + (sum(v == x for v in vals) + 1) / 2) / len(vals)
            assert got[d, c] == (None if want is None else pytest.approx(want))


def test_average_rank_case(spark):
    df = spark.createDataFrame([("d", "a", 10.0), ("d", "b", 20.0), ("d", "c", 20.0), ("d", "e", None)], "trade_date string, ts_code string, x double")
    got = {r.ts_code: r.r for r in ordering.average_rank(df, "x", ["trade_date"], "r", share=True).collect()}
    assert got == {"a": pytest.approx(1 / 3), "b": pytest.approx(5 / 6), "c": pytest.approx(5 / 6), "e": None}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("groups", [2, 3, 7])
def test_groups(hot, size, groups):
    rows, df = hot
    got = ordering.quantile_groups(df, "x", groups, ["trade_date"], rows_per_task=size).collect()
    for d, xs in by_date(rows).items():
        order = sorted([p for p in xs if p[1] is not None], key=lambda p: (-p[1], p[0]))
        base, extra = divmod(len(order), groups)
        want, at = {}, 0
        for g in range(groups):
            n = base + (1 if g < extra else 0)
            want.update({c: (g, pytest.approx(1 / n)) for c, _x in order[at : at + n]})
            at += n
        assert {r.ts_code: (r.group_no, r.weight) for r in got if r.trade_date == d} == want


def test_group_sizes(spark):
    df = spark.createDataFrame([("d", f"c{i}", float(i)) for i in range(7)], "trade_date string, ts_code string, x double")
    got = ordering.quantile_groups(df, "x", 3, ["trade_date"]).groupBy("group_no").count().orderBy("group_no").collect()
    assert [r["count"] for r in got] == [3, 2, 2]
    with pytest.raises(ValueError):
        ordering.quantile_groups(df, "x", 1, ["trade_date"])


@pytest.mark.parametrize("size", SIZES)
def test_nearest_rank_quantile_and_median(spark, size):
    df = spark.createDataFrame([("d", f"c{i}", float(i)) for i in range(1, 7)], "trade_date string, ts_code string, x double")
    q = ordering.nearest_rank_quantiles(df, "x", ["trade_date"], {"p50": 0.5}, rows_per_task=2 if size == 7 else size).first()
    assert (q["count"], q.p50) == (6, 3.0)
    assert ordering.upper_median(df, "x", ["trade_date"], rows_per_task=2 if size == 7 else size).first().median == 4.0


def test_composite_uses_what_a_code_has(spark):
    df = spark.createDataFrame(
        [("d", "a", 1.0, 5.0), ("d", "b", 3.0, 5.0), ("d", "c", None, 5.0), ("d", "e", None, None)],
        "trade_date string, ts_code string, x double, y double",
    )
    got = {r.ts_code: r.value for r in xsection.composite(df, {"x": 0.5, "y": 0.5}).collect()}
    z = 1 / 2**0.5
    assert got == {"a": pytest.approx(-z / 2), "b": pytest.approx(z / 2), "c": 0.0}


def test_ic_needs_three_pairs_and_spread(spark):
    rows = [("d1", 1.0, 2.0), ("d1", 2.0, 3.0), ("d2", 1.0, 1.0), ("d2", 1.0, 2.0), ("d2", 1.0, 3.0), ("d3", 1.0, 1.0), ("d3", 2.0, 9.0), ("d3", 3.0, 9.5)]
    df = spark.createDataFrame(rows, "trade_date string, f double, r double")
    got = {r.trade_date: (r.ic, r.rank_ic) for r in xsection.information_coefficient(df, "f", "r").collect()}
    assert got["d1"] == (None, None) and got["d2"] == (None, None)
    assert got["d3"][1] == pytest.approx(1.0)


def test_turnover_and_cost(spark):
    rows = [(1, "G0", "A", 0.5), (1, "G0", "B", 0.5), (2, "G0", "B", 0.5), (2, "G0", "C", 0.5)]
    held = spark.createDataFrame(rows, "rebalance_no long, group_id string, ts_code string, weight double")
    t = {r.rebalance_no: r for r in portfolio.turnover_by_group(portfolio.holdings_delta(held)).collect()}
    assert t[1].turnover == pytest.approx(1.0)
    assert t[2].turnover == pytest.approx(1.0) and t[2].cost == pytest.approx(0.0008)


@pytest.mark.parametrize("cuts", [256, 3])
@pytest.mark.parametrize("size", SIZES)
def test_null_groups_and_odd_values_at_every_size(spark, monkeypatch, size, cuts):
    """Null keys, nulls, NaN, both zeros and ties give the same whether a group is cut, cut again, or not."""
    monkeypatch.setattr(ordering, "_CUTS_AT_ONCE", cuts)
    odd = [None, float("nan"), 0.0, -0.0, 1.0, 1.0, float("inf")]
    rows = [(None if i % 2 else "d", f"c{i:03d}", odd[i % 7] if i % 3 else float(i)) for i in range(240)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, x double").repartition(3)
    text = lambda rs: sorted(str(tuple(r)) for r in rs.collect())
    whole, cut = 10_000_000, size
    by, key = ["trade_date"], [F.col("x") + 0.0, F.col("ts_code")]
    for f in (
        lambda n: ordering.positions(df.where("x is not null"), by, key, rows_per_task=n),
        lambda n: ordering.average_rank(df, "x", by, "r", rows_per_task=n),
        lambda n: ordering.quantile_groups(df, "x", 5, by, rows_per_task=n),
        lambda n: ordering.upper_median(df, "x", by, rows_per_task=n),
    ):
        assert text(f(whole)) == text(f(cut))
    assert ordering.average_rank(df, "x", by, "r", rows_per_task=size).where("trade_date is null and r is not null").count() > 90
    stats = ordering.with_group_stats(df, by, {"n": F.count(F.lit(1))})
    assert {r.n for r in stats.collect()} == {120}


@pytest.mark.parametrize("left", [1, 7, 4_096])
def test_selection_against_a_sort(spark, left):
    rng = random.Random(left)
    odd = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf"), 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0 + 2**-52]
    rows = [(g, rng.choice(odd) if rng.random() < 0.3 else rng.choice([rng.gauss(0, 1), rng.uniform(-1e6, 1e6), float(rng.randint(0, 3))]))
            for g in ("a", "b", None) for _ in range(400)]
    rows += [("one", 3.0), ("none", None), ("same", 2.0), ("same", 2.0), ("zeros", -0.0), ("zeros", 0.0)] + [("hot", 7.0)] * 500
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    got = {r.g: r for r in ordering.nearest_rank_quantiles(df, "x", ["g"], probs, rows_per_task=left).collect()}
    mid = {r.g: r.median for r in ordering.upper_median(df, "x", ["g"], rows_per_task=left).collect()}
    held = {}
    for g, x in rows:
        if x is not None:
            held.setdefault(g, []).append(x)
    assert set(got) == set(mid) == set(held)
    for g, xs in held.items():
        xs.sort(key=lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v))
        same = lambda a, b: (math.isnan(a) and math.isnan(b)) or a == b
        assert got[g]["count"] == len(xs) and same(mid[g], xs[len(xs) // 2])
        assert all(same(got[g][n], xs[round((len(xs) - 1) * p)]) for n, p in probs.items()), g


def test_selection_puts_no_group_in_order(spark):
    df = spark.range(20_000).selectExpr("'d' g", "cast(pow(1.001, id % 9973) as double) x")
    plan = ordering.upper_median(df, "x", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "x#" not in "".join(line for line in plan.splitlines() if "Sort [" in line or "Window [" in line)
