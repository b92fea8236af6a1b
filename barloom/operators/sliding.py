"""Rank and extremes of trailing windows whose time does not depend on the window's length.

A window frame would build the window's values as a list for every row. Here rows go to their code's task once, in order,
and whole codes are worked on as arrays, many codes at a time:

- rank: a wavelet matrix over the values' ranks counts the values at most v in any stretch in one step per bit of a rank;
- extremes: stretches of d rows are cut into two parts of blocks of d rows, whose running minima are kept from the left and
  from the right (van Herk), over a key that orders rows by value and then by place.

All columns of a call share one shuffle and one sort. A task holds a batch and the rows of one code beyond it, which the
calendar bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Sliding:
    """A column `out`: `rank`, `high_day` or `low_day` of column `x` over the last d rows."""

    out: str
    kind: str
    x: str
    d: int

    def __post_init__(self):
        if self.kind not in ("rank", "high_day", "low_day"):
            raise ValueError(f"unknown kind: {self.kind}")
        if self.d < 1:
            raise ValueError(f"window must be positive: {self.d}")


def count_at_most(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each query how many of ranks[low:high] are at most v."""
    total = np.zeros(len(v), np.int64)
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        zero = (ranks >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])
        zl, zh, ones = before[low], before[high], (v >> bit) & 1 == 1
        total += np.where(ones, zh - zl, 0)
        low, high = np.where(ones, before[-1] + low - zl, zl), np.where(ones, before[-1] + high - zh, zh)
        ranks = np.concatenate([ranks[zero], ranks[~zero]])
    return total + high - low


def sliding_min(key: np.ndarray, d: int) -> np.ndarray:
    """Minimum of the last d keys, for rows from d - 1 on."""
    blocks = np.pad(key, (0, -len(key) % d), constant_values=np.iinfo(np.int64).max).reshape(-1, d)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: len(key) - d + 1], left[d - 1 : len(key)])


def _rank(x: np.ndarray, first: np.ndarray, d: int) -> np.ndarray:
    """Share of the window's values that are at most the row's own, where there are d rows."""
    out, fine = np.full(len(x), np.nan), np.isfinite(x)
    held = np.concatenate([[0], np.cumsum(fine)])
    at = np.flatnonzero(fine & (np.arange(len(x)) - first >= d - 1))
    if len(at):
        _, ranks = np.unique(x[fine], return_inverse=True)
        low, high = held[at - d + 1], held[at + 1]
        out[at] = count_at_most(ranks, low, high, ranks[held[at]]) / (high - low)
    return out


def _extreme(x: np.ndarray, first: np.ndarray, d: int, sign: int) -> np.ndarray:
    """Rows since the window's first extreme, where all d values are there."""
    n, out, fine = len(x), np.full(len(x), np.nan), np.isfinite(x)
    if n < d:
        return out
    order = np.lexsort((np.arange(n), sign * np.where(fine, x, 0.0)))
    key = np.empty(n, np.int64)
    key[order] = np.arange(n)
    held = np.concatenate([[0], np.cumsum(fine)])
    at = np.arange(d - 1, n)
    whole = (at - first[d - 1 :] >= d - 1) & (held[d:] - held[: n - d + 1] == d)
    since = at - order[sliding_min(key, d)]
    out[d - 1 :] = np.where(whole, since, np.nan)
    return out


def whole_codes(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """The same rows, sorted by `by`, in pieces that hold whole codes."""
    rest = None
    for b in batches:
        now = pa.Table.from_batches([b])
        now = now if rest is None else pa.concat_tables([rest, now])
        codes = now.column(by)
        last = codes[len(codes) - 1].as_py() if len(codes) else None
        cut = len(codes)
        step = 1
        while cut and codes[cut - 1].as_py() == last:  # back to where the last code begins, in growing steps
            if cut >= step and codes[cut - step].as_py() == last:
                cut, step = cut - step, step * 2
            else:
                cut, step = (cut - 1, 1) if step == 1 else (cut, 1)
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def sliding(df: DataFrame, wanted: list[Sliding], by: str = "ts_code", order: str = "trade_date") -> DataFrame:
    """`by`, `order` and the wanted columns of every row. A value that is null or not finite is none: a rank is taken among
    the values that are there, an extreme needs all of them."""
    columns = sorted({w.x for w in wanted})
    fields = [df.schema[by], df.schema[order]] + [T.StructField(w.out, T.DoubleType()) for w in wanted]

    def run(batches):
        for t in whole_codes(batches, by):
            codes = t.column(by).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            n = len(codes)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            first = np.repeat(starts, np.diff(np.append(starts, n)))
            values = {c: t.column(c).to_numpy().astype(np.float64) for c in columns}
            out = []
            for w in wanted:
                x = values[w.x]
                v = _rank(x, first, w.d) if w.kind == "rank" else _extreme(x, first, w.d, -1 if w.kind == "high_day" else 1)
                out.append(pa.array(v, mask=np.isnan(v)))
            names = [by, order, *[w.out for w in wanted]]
            yield from pa.table([t.column(by), t.column(order), *out], names=names).to_batches()

    slim = df.select(by, order, *[df[c].cast("double").alias(c) for c in columns])
    return slim.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, T.StructType(fields))
