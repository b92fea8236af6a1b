"""Window operators whose cost does not depend on the window's length, against plain loops."""

import random

import numpy as np
import pytest

from barloom.operators import ewm, prefix, sliding


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    rows = []
    for code, n in (("a", 600), ("b", 1), ("c", 40), ("d", 7), ("e", 300)):
        for i in range(n):
            x = None if rng.random() < 0.1 else rng.choice([rng.gauss(0, 1), float(rng.randint(0, 4)), 0.0, -0.0])
            rows.append((code, f"{i:05d}", x, float(rng.randint(0, 5)), rng.uniform(1, 1e5)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ts_code string, trade_date string, x double, y double, z double").cache()


def per_code(df, columns):
    out = {}
    for r in df.orderBy("ts_code", "trade_date").collect():
        out.setdefault(r.ts_code, []).append(tuple(r[c] for c in columns))
    return out


def plain(kind, xs, t, d):
    w = xs[max(0, t - d + 1) : t + 1]
    there = [v for v in w if v is not None]
    if kind == "rank":
        return sum(v <= xs[t] for v in there) / len(there) if len(w) == d and xs[t] is not None else None
    if kind in ("high_day", "low_day"):
        best = max if kind == "high_day" else min
        return float(d - 1 - w.index(best(there))) if len(there) == d else None
    if kind == "wma":
        return sum((xs[t - k] or 0.0) * (d - k) for k in range(d) if t - k >= 0) / (d * (d + 1) / 2)
    if len(there) < d:
        return None
    if kind in ("sum", "mean"):
        return sum(w) / (d if kind == "mean" else 1)
    at = np.arange(1, d + 1) - (d + 1) / 2
    return float((at * np.array(w)).sum() / ((at * at).sum() or 1.0))


@pytest.mark.parametrize("d", [1, 2, 5, 64, 250])
def test_sliding_against_plain(data, d):
    wanted = [sliding.Sliding(f"{k}_{c}", k, c, d) for k in ("rank", "high_day", "low_day") for c in ("x", "y")]
    got = per_code(sliding.sliding(data, wanted), [w.out for w in wanted])
    for code, rows in per_code(data, ["x", "y"]).items():
        series = {"x": [r[0] for r in rows], "y": [r[1] for r in rows]}
        for t in range(len(rows)):
            assert got[code][t] == tuple(plain(w.kind, series[w.x], t, d) for w in wanted), (code, t)


@pytest.mark.parametrize("d", [1, 2, 5, 64, 250])
def test_prefix_against_plain(data, d):
    wanted = [prefix.Weighted(f"{k}_{c}", k, c, d) for k in ("wma", "slope", "sum", "mean") for c in ("x", "z")]
    got = per_code(prefix.weighted(data, wanted), [w.out for w in wanted])
    for code, rows in per_code(data, ["x", "z"]).items():
        series = {"x": [r[0] for r in rows], "z": [r[1] for r in rows]}
        for t in range(len(rows)):
            for w, v in zip(wanted, got[code][t]):
                want = plain(w.kind, series[w.x], t, d)
                assert (v is None) == (want is None) and (v is None or v == pytest.approx(want, rel=1e-7, abs=1e-6)), (code, t, w)


def test_the_plan_does_not_grow_with_the_window(data):
    def plan(d):
        df = prefix.weighted(data, [prefix.Weighted("a", "wma", "x", d), prefix.Weighted("b", "slope", "x", d + 1)])
        return df._jdf.queryExecution().executedPlan().toString()

    assert plan(5).count("Exchange") == plan(250).count("Exchange") == 1 and abs(len(plan(5)) - len(plan(250))) < 100


@pytest.mark.parametrize(("n", "m"), [(2, 1), (8, 2), (60, 1), (1000, 999), (3, 3)])
def test_smoothing_against_a_loop(data, n, m):
    a = m / n
    got = per_code(ewm.sma(data, "x", n, m), ["sma"])
    for code, rows in per_code(data, ["x"]).items():
        y = None
        for t, (x,) in enumerate(rows):
            if x is not None:
                y = x if y is None else a * x + (1 - a) * y
            (v,) = got[code][t]
            assert v is None if x is None else v == pytest.approx(y, rel=1e-9, abs=1e-12), (code, t)


def test_smoothing_over_many_blocks(spark):
    n = 3_000
    df = spark.range(n).selectExpr("'a' ts_code", "lpad(cast(id as string), 6, '0') trade_date", "cast(id % 97 as double) + 1 x")
    got = [r.sma for r in ewm.sma(df, "x", 4, 3).orderBy("trade_date").collect()]  # blocks of 67 values
    y = None
    for i, v in enumerate(got):
        y = i % 97 + 1.0 if y is None else 0.75 * (i % 97 + 1) + 0.25 * y
        assert v == pytest.approx(y, rel=1e-9)
    assert "Python" not in ewm.sma(df, "x", 4, 3)._jdf.queryExecution().executedPlan().toString()


def test_wrong_requests():
    for make in (lambda: sliding.Sliding("o", "median", "x", 3), lambda: sliding.Sliding("o", "rank", "x", 0), lambda: prefix.Weighted("o", "wma", "x", 0)):
        with pytest.raises(ValueError):
            make()
