"""The set-based backtest against a plain loop over the rebalance dates, on a small market with gaps."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.scalars import CostRates
from barloom.plans import backtest

N_GROUPS = 3
RATES = CostRates(0.0003, 0.001, 0.0002)


@pytest.fixture(scope="module")
def market(spark):
    rnd = random.Random(11)
    days = [f"2024{m:02d}{d:02d}" for m in range(1, 7) for d in range(1, 29, 3)]
    codes = [f"60000{i}.SH" for i in range(9)]
    bars, factor = {}, {}
    for c in codes:
        price = 10.0
        for d in days:
            if rnd.random() < 0.1:
                continue  # no bar
            price *= 1 + rnd.uniform(-0.05, 0.05)
            adj = None if rnd.random() < 0.1 else 1.0
            limit = rnd.random() < 0.1
            bars[c, d] = (price, adj, price if limit else price * 1.2, price * 0.8)
            if rnd.random() < 0.9 and d[4:6] != "03":  # March has no cross-section
                factor[c, d] = round(rnd.uniform(0, 3), 1)
    listing = {c: ("20230101" if i else "20240401", "20240515" if i == 8 else "", "ST x" if i == 7 else "x") for i, c in enumerate(codes)}
    halted = {(codes[2], d) for d in days if d[4:6] == "02"} | {(codes[3], days[-1])}
    frames = dict(
        bars=spark.createDataFrame([(c, d, *v) for (c, d), v in bars.items()], "ts_code string, trade_date string, close double, adj_factor double, up_limit double, down_limit double"),
        factors=spark.createDataFrame([(c, d, v) for (c, d), v in factor.items()], "ts_code string, trade_date string, f double"),
        listing=spark.createDataFrame([(c, *v[:2], v[2], "SSE") for c, v in listing.items()], "ts_code string, list_date string, delist_date string, name string, exchange string"),
        calendar=spark.createDataFrame([("SSE", d, "1") for d in days], "exchange string, cal_date string, is_open string"),
        suspend=spark.createDataFrame([(c, d, "S", "") for c, d in halted], "ts_code string, trade_date string, suspend_type string, suspend_timing string"),
    )
    return days, codes, bars, factor, listing, halted, frames


def loop(market, start, end):
    """What a run yields, date by date."""
    from datetime import datetime, timedelta

    days, codes, bars, factor, listing, halted, _f = market
    opens = [d for d in days if start <= d <= end]
    last = {}
    for d in opens:
        last[d[:6]] = d
    reb = sorted(last.values())
    ret, prev = {}, {}
    for c in codes:
        for d in opens:
            if (c, d) in bars:
                p = bars[c, d][0] * (bars[c, d][1] or 1.0)
                if c in prev:
                    ret[c, d] = p / prev[c] - 1
                prev[c] = p
    held = {g: {} for g in range(N_GROUPS)}
    out = dict(portfolio={}, trades={}, turnover={}, returns={}, pairs={})
    for td, nxt in zip(reb, reb[1:]):
        cross = {c: factor[c, td] for c in codes if (c, td) in factor}
        if not cross:
            held = {g: {} for g in range(N_GROUPS)}
            continue
        cutoff = (datetime.strptime(td, "%Y%m%d") - timedelta(days=60)).strftime("%Y%m%d")
        ok = {
            c for c, (born, gone, name) in listing.items()
            if born <= td and (not gone or gone > td) and "ST" not in name and born <= cutoff and (c, td) not in halted
        }
        order = sorted([c for c in cross if c in ok], key=lambda c: (-cross[c], c))
        base, extra = divmod(len(order), N_GROUPS)
        at, turn, cost = 0, 0.0, {}
        for g in range(N_GROUPS):
            n = base + (g < extra)
            picks = order[at : at + n]
            at += n
            free = [c for c in picks if not ((c, td) in bars and (bars[c, td][0] >= bars[c, td][2] * 0.999 or bars[c, td][0] <= bars[c, td][3] * 1.001))]
            now = {c: 1 / len(free) for c in free}
            cost[g] = 0.0
            for c in set(now) | set(held[g]):
                dw = now.get(c, 0) - held[g].get(c, 0)
                if abs(dw) >= 1e-12:
                    paid = abs(dw) * (RATES.commission + RATES.slippage + (RATES.stamp_duty if dw < 0 else 0))
                    out["trades"][td, f"G{g}", c] = (dw, paid)
                    cost[g] += paid
                    turn += abs(dw)
            held[g] = now
            out["portfolio"].update({(td, f"G{g}", c): w for c, w in now.items()})
        out["turnover"][td] = turn / N_GROUPS
        seg = [d for d in opens if td < d <= nxt]
        for j, d in enumerate(seg):
            out["returns"][d] = [sum(w * ret.get((c, d), 0.0) for c, w in held[g].items()) - (cost[g] if j == 0 else 0) for g in range(N_GROUPS)]
        for c in order:
            got = [ret[c, d] for d in seg if (c, d) in ret]
            if got:
                wealth = 1.0
                for r in got:
                    wealth *= 1 + r
                out["pairs"].setdefault(td, []).append((cross[c], wealth - 1))
    return out


@pytest.fixture(scope="module")
def both(market):
    run = backtest.Backtest(**market[-1], strategy=backtest.SingleFactor("f", N_GROUPS), start="20240101", end="20240630", rates=RATES)
    return run, loop(market, "20240101", "20240630")


def close(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


def test_holdings(both):
    run, want = both
    close({(r.trade_date, r.group_id, r.ts_code): r.weight for r in run.portfolio.collect()}, want["portfolio"])


def test_trades_and_turnover(both):
    run, want = both
    close({(r.trade_date, r.group_id, r.ts_code): (r.delta_weight, r.cost) for r in run.trades.collect()}, want["trades"])
    close({r.trade_date: r.turnover for r in run.turnover.collect()}, want["turnover"])


def test_daily_returns_and_skipped_month(both):
    run, want = both
    rows = run.returns.collect()
    close({r.trade_date: [r[f"G{g}"] for g in range(N_GROUPS)] for r in rows}, want["returns"])
    assert all(r.long_short == pytest.approx(r.G0 - r.G2, abs=1e-12) for r in rows)
    assert not any(r.trade_date[4:6] == "04" for r in rows)  # March held nothing, so April has no days


def test_ic(both):
    import pandas as pd

    run, want = both
    for r in run.ic.collect():
        pairs = pd.DataFrame(want["pairs"].get(r.trade_date, []), columns=["f", "r"])
        if len(pairs) < 3 or pairs.f.nunique() < 2:
            assert r.ic is None
        else:
            assert r.ic == pytest.approx(pairs.f.corr(pairs.r))
            assert r.rank_ic == pytest.approx(pairs.f.rank().corr(pairs.r.rank()))


def test_weights_sum_to_one(both):
    sums = both[0].portfolio.groupBy("trade_date", "group_id").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == pytest.approx(1.0) for r in sums)


def test_summary_is_one_row(both):
    s = backtest.summary(both[0], {"strategy": "single_factor_f"}).collect()
    assert len(s) == 1 and s[0].strategy == "single_factor_f" and s[0].n_rebalance == len(both[1]["turnover"])


def test_bad_inputs_are_errors(market):
    frames = market[-1]
    run = lambda start="20240101", end="20240630", **other: backtest.Backtest(
        **{**frames, **other}, strategy=backtest.SingleFactor("f", N_GROUPS), start=start, end=end
    )
    with pytest.raises(ValueError, match="no such range"):
        run("20240201", "20240101")
    with pytest.raises(ValueError, match="no such range"):
        run("", "20240101")
    with pytest.raises(ValueError, match="lack the columns"):
        run(bars=frames["bars"].drop("up_limit"))
    with pytest.raises(ValueError, match="lack the columns"):
        run(factors=frames["factors"].drop("f"))
    with pytest.raises(ValueError, match="two rebalances"):
        run("20240101", "20240120")
    with pytest.raises(ValueError, match="no bars"):
        run(bars=frames["bars"].limit(0))


def test_what_several_outputs_read_is_worked_out_once(both):
    run, _want = both
    for name in ("rets", "changes", "turnover", "ic", "returns"):
        assert getattr(run, name) is getattr(run, name), name
        plan = getattr(run, name)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(step in plan for step in ("Window", "Join", "Aggregate")), name
