"""Day bitmaps against plain sets of days."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import daybits, gaps


def made_up(rng, n_days, n_codes):
    days = sorted(rng.sample([f"20{y:02d}{m:02d}{d:02d}" for y in range(3) for m in range(1, 13) for d in range(1, 29)], n_days))
    odd = ["", None, "19000101", "20991231", "2001", days[0], days[-1]]
    pick = lambda: rng.choice(odd) if rng.random() < 0.4 else rng.choice(days)
    listing = [(f"c{i}", pick(), pick()) for i in range(n_codes)]
    have = [(f"c{rng.randrange(n_codes + 2)}", rng.choice([*days, "20050101"])) for _ in range(n_days * n_codes // 2)]
    halted = [(f"c{rng.randrange(n_codes)}", rng.choice(days)) for _ in range(n_codes * 5)]
    return days, listing, have, halted


def plain(days, listing, have, halted, keep, need):
    seen, out = set(have) | set(halted), {}
    for c, lo, hi in listing:
        if need and not lo:
            continue
        alive = [d for d in days if d >= (lo or "") and (not hi or d < hi or (keep and d == hi))]
        out[c] = [d for d in alive if (c, d) not in seen]
    return out


@pytest.mark.parametrize(("seed", "n_days", "keep", "need"), [(1, 200, False, False), (2, 64, True, False), (3, 130, False, True), (4, 1, True, True)])
def test_missing_as_sets_of_days(spark, seed, n_days, keep, need):
    days, listing, have, halted = made_up(random.Random(seed), n_days, 12)
    opens = spark.createDataFrame([(d,) for d in days * 2], "trade_date string")
    life = spark.createDataFrame(listing, "ts_code string, list_date string, delist_date string")
    rows = spark.createDataFrame(have + have, "ts_code string, trade_date string")
    off = spark.createDataFrame(halted, "ts_code string, trade_date string")
    given = dict(suspended=off, keep_delist_day=keep, need_list_date=need)
    want = plain(days, listing, have, halted, keep, need)
    got = sorted(map(tuple, gaps.missing_days(life, opens, rows, **given).collect()))
    assert got == sorted((c, d) for c, missing in want.items() for d in missing)
    ranges = []
    for c, missing in want.items():
        at = [days.index(d) for d in missing]
        starts = [i for i in at if i - 1 not in at]
        ends = [i for i in at if i + 1 not in at]
        ranges += [(c, days[a], days[b], b - a + 1) for a, b in zip(starts, ends)]
    assert sorted(map(tuple, gaps.missing_ranges(life, opens, rows, **given).collect())) == sorted(ranges)
    spans = [(c, m[0], m[-1], len(m)) for c, m in want.items() if m]
    assert sorted(map(tuple, gaps.missing_spans(life, opens, rows, **given).collect())) == sorted(spans)


def test_sets_of_one_word_top_to_bottom(spark):
    days = [f"{n:05d}" for n in range(64 * 3)]
    opens = spark.createDataFrame([(d,) for d in days], "d string")
    calendar = daybits.Calendar.of(opens, "d")
    keys = spark.createDataFrame([("a", d) for d in days] + [("b", days[63]), ("b", days[64]), ("c", days[0]), ("c", days[191])], "k string, d string")
    words = daybits.combined([daybits.held(keys, calendar, "k", "d")], "k")
    assert sorted(map(tuple, daybits.runs_of(words, calendar, "k").collect())) == [
        ("a", "00000", "00191", 192), ("b", "00063", "00064", 2), ("c", "00000", "00000", 1), ("c", "00191", "00191", 1)
    ]


def test_span_of_a_word_with_its_sign_bit_alone(spark):
    days = [f"{n:05d}" for n in range(64 * 3)]
    opens = spark.createDataFrame([(d,) for d in days], "trade_date string")
    life = spark.createDataFrame([("a", "00000", ""), ("b", "00000", "")], "ts_code string, list_date string, delist_date string")
    have = spark.createDataFrame([("a", d) for d in days if d != days[63]] + [("b", d) for d in days if d not in (days[127], days[128])], "ts_code string, trade_date string")
    assert sorted(map(tuple, gaps.missing_spans(life, opens, have).collect())) == [("a", "00063", "00063", 1), ("b", "00127", "00128", 2)]


def test_dated_sets_unite(spark):
    rows = [("a", "19691231"), ("a", "20240229"), ("a", "19700101"), ("b", "20240301"), ("a", "20240229")]
    parts = [daybits.dated(spark.createDataFrame(r, "k string, d string"), "k", "d") for r in (rows[:3], rows[3:])]
    got = {r.k: (r.n_days, r.days) for r in daybits.listed(daybits.combined(parts, "k"), "k").collect()}
    assert got == {"a": (3, ["19691231", "19700101", "20240229"]), "b": (1, ["20240301"])}


def test_no_calendar_no_codes(spark):
    none = spark.createDataFrame([], "ts_code string, trade_date string")
    life = spark.createDataFrame([("a", "", "")], "ts_code string, list_date string, delist_date string")
    assert gaps.missing_days(life, none, none).count() == 0
    assert gaps.missing_ranges(life.where(F.lit(False)), none, none).count() == 0
