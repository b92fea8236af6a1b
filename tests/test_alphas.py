"""The expression graph of many alphas."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling as ts
from barloom.plans import alphas


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("panel") / "p")
    rows = spark.range(40 * 6).selectExpr("concat('c', id % 6) ts_code", "lpad(cast(id div 6 as string), 8, '0') trade_date", "cast((id * 37) % 101 as double) c", "cast(id as double) unused")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def c():
    return F.col("c")


def a_hundred():
    """A hundred alphas over ten parts, each of which has ten names, and ranks of parts."""
    out = []
    for i in range(100):
        d = i % 10 + 2
        part, rank = f"mean_{i}", f"rank_{i}"
        out.append(
            alphas.Alpha(
                f"alpha_{i}",
                lambda part=part, rank=rank, i=i: F.col(part) * (i + 1) + F.col(rank),
                ((rank, lambda d=d: ts.ts_sum(c(), d)),),
                ((part, lambda d=d: ts.ts_mean(c(), d)),),
            )
        )
    return out


def test_equal_expressions_are_one_column(spark):
    built, names = alphas.shared([p for a in a_hundred() for p in a.parts])
    assert len(built) == 10 and len(names) == 100 and names["mean_10"] == "mean_0" == names["mean_90"]
    with pytest.raises(ValueError, match="two expressions"):
        alphas.shared([("a", c), ("a", lambda: c() + 1)])


def test_the_panel_is_read_once(panel, monkeypatch):
    staged = []
    stage = alphas.stage
    monkeypatch.setattr(alphas, "stage", lambda df: staged.append(df) or stage(df))
    out = alphas.compute(panel, a_hundred())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unused" not in plan and len(staged) == 2
    # The first staged table is the panel with its parts; the second holds what the values read.
    assert staged[0]._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert "unused" not in staged[1].columns


def test_values_of_many_alphas(panel):
    few = a_hundred()[:7]
    one = {(r.ts_code, r.trade_date, r.factor_name): r.value for r in alphas.compute(panel, a_hundred()).collect()}
    alone = {(r.ts_code, r.trade_date, r.factor_name): r.value for a in few for r in alphas.compute(panel, [a]).collect()}
    names = {a.name for a in few}
    assert alone and alone == {k: v for k, v in one.items() if k[2] in names}


def test_names_must_not_clash(panel):
    with pytest.raises(ValueError, match="named twice"):
        alphas.prepared(panel, [alphas.Alpha("x", c, parts=(("c", c),))])
