"""The panel: bars with look-back, derived price fields and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as ts
from barloom.functions import scalars
from barloom.operators import factorset
from barloom.sources.bars import with_adjusted


def build(bars: DataFrame, index_daily: DataFrame | None = None, benchmark: str = "000300.SH") -> DataFrame:
    """Adjusted prices, VWAP, return, directional moves, true range and benchmark. All lags share one window: one
    shuffle by code and one sort."""
    adj = with_adjusted(bars)
    o, h, l, c = (F.col(f"{n}_adj") for n in ("open", "high", "low", "close"))
    fields = {"vwap": scalars.vwap(F.col("amount"), F.col("vol")), "ret": ts.simple_return(c)}
    return factorset.attach_benchmark(adj.withColumns(fields | scalars.directional(o, h, l, c)), index_daily, benchmark)
