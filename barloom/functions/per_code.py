"""Functions over one code's whole history, as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def apply_per_code(df: DataFrame, columns: list[str], fn: Callable, out: str) -> DataFrame:
    """`fn(**arrays) -> array` over each code's columns in date order; NaN becomes null.

    One Arrow group per code, bounded by its trading days. Use it only where no window expresses the function.
    """

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("trade_date", kind="stable")
        pdf[out] = np.asarray(fn(**{c: pdf[c].to_numpy(dtype="float64") for c in columns}), dtype="float64")
        return pdf[["ts_code", "trade_date", out]]

    schema = T.StructType(
        [T.StructField("ts_code", T.StringType()), T.StructField("trade_date", T.StringType()), T.StructField(out, T.DoubleType())]
    )
    return df.select("ts_code", "trade_date", *columns).groupBy("ts_code").applyInPandas(run, schema)
