"""Alphas: named formulas over the panel, computed many at a time as one expression graph.

An alpha is a column expression over the panel, or a text for `F.expr`. What it builds on are named columns of two kinds:
`parts` (rolling columns of one code) and `ranks` (cross-section ranks, over the panel or over parts). Equal expressions,
whatever their names, are one column, built once for all alphas: parts in one window stage, then ranks, which are a barrier
between windows by code and windows by date, then the values. The columns that values read are staged, so the panel is read
once however many batches of values follow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import rolling as ts
from barloom.functions import scalars
from barloom.operators import factorset, ordering
from barloom.session import stage

# Fixed value: trading days of look-back that cover every alpha.
LOOKBACK_DAYS = 260
# Alphas per plan, which keeps the generated code of one stage within limits.
BATCH = 32


Named = tuple[str, Callable[[], Column]]


@dataclass(frozen=True)
class Alpha:
    """`build` maps prepared columns to the value; `parts` and `ranks` name what it reads besides the panel's columns. A
    part may read panel columns, a rank also parts, a value all of them."""

    name: str
    build: Callable[[], Column]
    ranks: tuple[Named, ...] = ()
    parts: tuple[Named, ...] = ()


def from_text(name: str, formula: str) -> Alpha:
    """An alpha from a Spark SQL expression over the panel; a bad formula is an error, not a silent skip."""
    return Alpha(name, lambda: F.expr(formula))


def _text(c: Column) -> str:
    """An expression as text: equal trees have equal texts."""
    return c._jc.toString()


def shared(named: list[Named]) -> tuple[dict[str, Column], dict[str, str]]:
    """The distinct expressions, by the first of their names, and the name under which each one is built. One name for two
    expressions is an error."""
    first, built, seen = {}, {}, {}
    for name, build in named:
        column = build()
        text = _text(column)
        if seen.setdefault(name, text) != text:
            raise ValueError(f"two expressions for the column {name}")
        if text not in first:
            first[text] = name
            built[name] = column
    return built, {name: first[text] for name, text in seen.items()}


def prepared(panel: DataFrame, alphas: list[Alpha]) -> DataFrame:
    """The panel with every part and rank of the alphas: each distinct expression is one column, other names copy it."""
    parts, part_names = shared([p for a in alphas for p in a.parts])
    ranks, rank_names = shared([r for a in alphas for r in a.ranks])
    clash = [n for n in [*part_names, *rank_names] if n in panel.columns] + [n for n in part_names if n in rank_names]
    if clash:
        raise ValueError(f"columns named twice: {sorted(set(clash))}")
    copies = lambda names, built: {n: F.col(of) for n, of in names.items() if n not in built}
    out = panel.withColumns(parts).withColumns(copies(part_names, parts)) if parts else panel
    if ranks:
        out = ordering.average_ranks(stage(out) if parts else out, ranks, ["trade_date"], share=True).withColumns(copies(rank_names, ranks))
    return out


def _reads(column: Column, names: list[str]) -> set[str]:
    """Which of the columns an expression may read; a name inside another counts, which only keeps a column more."""
    text = _text(column)
    return {n for n in names if n in text}


def compute(panel: DataFrame, alphas: list[Alpha], month: str | None = None) -> DataFrame:
    """Long factor rows of the alphas, nulls dropped, trimmed to the month."""
    ready, values = prepared(panel, alphas), [(a.name, a.build()) for a in alphas]
    if len(alphas) > BATCH:
        read = set().union(*[_reads(v, ready.columns) for _, v in values])
        ready = stage(ready.select("ts_code", "trade_date", *[c for c in ready.columns if c in read and c not in factorset.KEYS]))
    parts = []
    for i in range(0, len(values), BATCH):
        batch = values[i : i + BATCH]
        wide = ready.select("ts_code", "trade_date", *[ts.finite(v.cast("double")).alias(n) for n, v in batch])
        if month:
            wide = wide.where(F.substring("trade_date", 1, 6) == month)
        parts.append(factorset.long(wide, [n for n, _ in batch]))
    return reduce(DataFrame.unionByName, parts)


def pending(alphas: list[Alpha], existing: DataFrame, month: str, force: bool = False) -> list[Alpha]:
    """Alphas without a stored partition for the month (at most one listed name per alpha)."""
    if force:
        return alphas
    names = [a.name for a in alphas]
    have = existing.where((F.col("dt") == month) & F.col("factor_name").isin(names)).select("factor_name").distinct()
    done = {r.factor_name for r in have.collect()}
    return [a for a in alphas if a.name not in done]


def demo() -> list[Alpha]:
    """Compositions that use every kind of operator."""
    c, v, high, low = F.col("close_adj"), F.col("vol"), F.col("high_adj"), F.col("low_adj")
    return [
        Alpha("demo_reversal", lambda: -ts.delta(c, 5) / c),
        Alpha("demo_price_volume", lambda: ts.ts_corr(c, v, 6)),
        Alpha("demo_range", lambda: F.try_divide(c - ts.ts_min(low, 9), ts.ts_max(high, 9) - ts.ts_min(low, 9))),
        Alpha("demo_decay", lambda: ts.decay_linear(F.col("ret"), 4)),
        Alpha("demo_up_share", lambda: ts.ts_count(F.col("ret") > 0, 6) / 6.0),
        Alpha("demo_directional", lambda: (ts.ts_sum(F.col("dtm"), 5) - ts.ts_sum(F.col("dbm"), 5)) / c),
        Alpha("demo_rank_gap", lambda: F.col("rank_vol") - F.col("rank_ret"), (("rank_vol", lambda: v), ("rank_ret", lambda: F.col("ret")))),
        Alpha("demo_rank_corr", lambda: ts.ts_corr(F.col("rank_vol"), F.col("rank_ret"), 5), (("rank_vol", lambda: v), ("rank_ret", lambda: F.col("ret")))),
        from_text("demo_text", "case when close_adj > open_adj then (close_adj - open_adj) / open_adj else 0.0 end"),
        Alpha("demo_self", lambda: scalars.where(F.col("ret") > 0.1, F.lit(0.0), F.col("tr") / c)),
    ]
