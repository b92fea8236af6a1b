"""Hand-checked cases of the trailing-window functions."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling as ts
from barloom.functions import scalars
from barloom.functions.per_code import apply_per_code
from barloom.operators import ewm

N = None
X, Y = (lambda: F.col("x")), (lambda: F.col("y"))

CASES = [
    ("delay", lambda: ts.delay(X(), 1), [1, 3, 2], [N, 1, 3]),
    ("delta", lambda: ts.delta(X(), 1), [1, 3, 2], [N, 2, -1]),
    ("sum", lambda: ts.ts_sum(X(), 2), [1, 3, N, 2], [N, 4, N, N]),
    ("mean", lambda: ts.ts_mean(X(), 2), [1, 3, N, 2], [N, 2, N, N]),
    ("std", lambda: ts.ts_std(X(), 3), [1, 3, 2], [N, N, 1]),
    ("wma", lambda: ts.wma(X(), 3), [1, 2, 3], [0.5, 4 / 3, 7 / 3]),
    ("wma of one", lambda: ts.wma(X(), 1), [1, N], [1, N]),
    ("rank", lambda: ts.ts_rank(X(), 3), [1, 3, 2], [N, N, 2 / 3]),
    ("rank with gap", lambda: ts.ts_rank(X(), 3), [1, N, 2, N], [N, N, 1, N]),
    ("high day", lambda: ts.high_day(X(), 3), [1, 3, 2, 3], [N, N, 1, 2]),
    ("low day", lambda: ts.low_day(X(), 3), [3, 1, 2], [N, N, 1]),
    ("slope on time", lambda: ts.reg_beta_seq(X(), 3), [1, 3, 2], [N, N, 0.5]),
    ("product", lambda: ts.ts_prod(X(), 2), [2, 3, 0], [N, 6, 0]),
    ("product of negative", lambda: ts.ts_prod(X(), 2), [2, -3, 4], [N, N, N]),
    ("sumif", lambda: ts.ts_sumif(X(), 2, X() > 1), [1, 3, 2], [N, 3, 5]),
    ("sumif of null", lambda: ts.ts_sumif(F.lit(1.0), 2, X() > 1), [1, N, 2], [N, 0, 1]),
    ("count", lambda: ts.ts_count(X() > 1, 2), [1, 3, 2], [N, 1, 2]),
    ("max", lambda: ts.ts_max(X(), 2), [1, 3, 2, N], [N, 3, 3, N]),
    ("min", lambda: ts.ts_min(X(), 2), [1, 3, 2, N], [N, 1, 2, N]),
    ("running sum", lambda: ts.sum_ac(X()), [1, N, 2], [1, N, 3]),
    ("constant correlation", lambda: ts.ts_corr(X(), X() * 0, 2), [1, 2, 3], [N, N, N]),
    ("correlation", lambda: ts.ts_corr(X(), -X(), 2), [1, 2, 5], [N, -1, -1]),
    ("covariance", lambda: ts.ts_cov(X(), X(), 3), [1, 3, 2], [N, N, 1]),
    ("sign", lambda: scalars.sign(X()), [-2, 0, N], [-1, 0, 0]),
    ("log", lambda: scalars.log(X()), [1, 0, -1], [0, N, N]),
    ("where", lambda: scalars.where(X() > 1, F.lit(1.0), F.lit(2.0)), [2, 1, N], [1, 2, 2]),
    ("finite", lambda: ts.finite(X()), [1, float("nan"), float("inf")], [1, N, N]),
]


@pytest.mark.parametrize("name,fn,x,want", CASES, ids=[c[0] for c in CASES])
def test_case(series, name, fn, x, want):
    got = series(fn, x=[None if v is None else float(v) for v in x])
    assert got == [None if v is None else pytest.approx(v) for v in want]


def test_slope_of_pairs(series):
    assert series(lambda: ts.reg_beta(Y(), X(), 3), y=[2.0, 5.0, 2.0], x=[1.0, 3.0, 2.0]) == [N, N, pytest.approx(1.5)]
    assert series(lambda: ts.reg_beta(Y(), X(), 3), y=[2.0, 5.0, 2.0], x=[1.0, 1.0, 1.0]) == [N, N, N]
    # four of eight pairs are enough for a window of eight, three are not
    y = [1.0, N, 2.0, N, 3.0, N, 4.0, N]
    assert series(lambda: ts.reg_beta(Y(), Y(), 8), y=y)[-1] == pytest.approx(1.0)
    assert series(lambda: ts.reg_beta(Y(), Y(), 8), y=[N] * 2 + y[2:])[-1] is N


def test_sma_keeps_its_state_over_nulls(spark):
    rows = [("A", "1", 1.0), ("A", "2", 3.0), ("A", "3", N), ("A", "4", 2.0), ("B", "1", 5.0)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date string, x double")
    got = {(r.ts_code, r.trade_date): r.sma for r in ewm.sma(df, "x", 2, 1).collect()}
    assert got == {("A", "1"): 1.0, ("A", "2"): 2.0, ("A", "3"): N, ("A", "4"): 2.0, ("B", "1"): 5.0}


def test_later_rows_do_not_change_earlier_values(spark):
    fns = [ts.ts_mean(X(), 3), ts.wma(X(), 3), ts.ts_rank(X(), 3), ts.high_day(X(), 3), ts.momentum(X(), 2)]
    rows = [("A", f"{i:02d}", float(i * 7 % 5)) for i in range(20)]
    run = lambda rs: {
        r.trade_date: r[1:]
        for r in spark.createDataFrame(rs, "ts_code string, trade_date string, x double")
        .where("x > 0")
        .select("trade_date", *[f.alias(f"v{i}") for i, f in enumerate(fns)])
        .collect()
    }
    short, whole = run(rows[:12]), run(rows)
    assert all(whole[d] == v for d, v in short.items())


def test_first_bar_has_partial_moves(series):
    cols = dict(o=[10.0, 11.0], h=[12.0, 11.5], l=[9.0, 8.0], c=[11.0, 9.0])
    d = lambda k: lambda: scalars.directional(*[F.col(n) for n in "ohlc"])[k]
    assert series(d("dtm"), **cols) == [2.0, 1.0]
    assert series(d("tr"), **cols) == [3.0, 3.5]
    assert series(d("hd"), **cols) == [0.0, 0.5]
    assert series(d("ld"), **cols) == [0.0, 1.0]


def test_per_code_function(spark):
    df = spark.createDataFrame([("A", "2", 2.0), ("A", "1", 1.0), ("B", "1", 4.0)], "ts_code string, trade_date string, x double")

    def shifted(x):
        import numpy as np

        return np.concatenate([[np.nan], x[:-1]])

    got = {(r.ts_code, r.trade_date): r.y for r in apply_per_code(df, ["x"], shifted, "y").collect()}
    assert got == {("A", "1"): N, ("A", "2"): 1.0, ("B", "1"): N}
