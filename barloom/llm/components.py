"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond").

Each step is an aggregate and an equi-join, so a node with very many neighbours is combined map-side and its join
partition can be split; the number of edges never grows. Every round is cut by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of `edges` (a, b: long): the smallest id reachable. Loops and repeated edges do
    no harm, rows with a null end are ignored, no edges give no rows."""
    a, b = F.col("a"), F.col("b")
    clean = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    now = stage(clean.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        now = stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        last, seen = seen, _state(now)
        if seen == last:
            break
    roots = now.select(b.alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(a.alias("id"), b.alias("component")).unionByName(roots)
