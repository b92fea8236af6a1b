"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken `target / source size` times. The whole part is certain; the fractions are rounded
by the pivotal method: two documents pool their fractions, one of them becomes 0 or 1 at random and the other carries the
rest on. That keeps each document's expected copies and the source's sum of copies, and because documents of like size meet
first, the source's words stay near the target.

The pairing is a reduction tree: blocks of about `BLOCK` documents of one source and size class are reduced to one residual
each, residuals to one per block of blocks, then one per source over its size classes; the last one is rounded. A source
with any share of all rows is so many blocks. Random numbers are hashes of the ids, so reruns agree.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, the last in order;
a source without words has target 0; repeated rows are rounded row by row; further columns are ignored by `mixture` and kept
by `mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, broadcast_few
from barloom.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
# Copies of this many documents are broadcast to the texts: 16 bytes each.
COPY_ROWS = 500_000
# Size classes for each doubling of the size: a source has this many times log2 of its longest text at most.
CLASSES = 16
SEED = 20_240_601


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text) and key, null where the id tells a row from all others."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select("doc_id", "source", n.cast("long").alias("size"), F.lit(None).cast("long").alias("key"))


def _size_class(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size) * CLASSES)).otherwise(-1).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds sid and target to (source, source_size): the share of all sizes dealt by the repeating weights in order of the
    sources, no target above `most` times the source; what is cut is dealt again by weight until none is above.

    That is the level at which min(cap, level * weight) sums to the share: the largest of the levels that follow when the
    sources of smallest cap per weight are filled one after the other. The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("sid", F.row_number().over(order) - 1).withColumn("w", weight)
    rows = rows.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) * share - before) / open_)
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("w"))).select(
        "source", "sid", "source_size", "target"
    )


def _uniform(*of: Column) -> Column:
    return F.pmod(F.xxhash64(*of, F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _reduce(units: DataFrame, by: list[str], level: int) -> DataFrame:
    """One row per group: `done`, its rounded documents with their extra copy, and the residual `c`."""
    first = F.col("units")[0]
    none = F.expr("cast(array() as array<struct<id: bigint, key: bigint, size: bigint, copy: int>>)")
    start = F.struct(first.alias("c"), none.alias("done"))

    def settled(x: Column, copy: int) -> Column:
        return F.struct(x["id"].alias("id"), x["key"].alias("key"), x["size"].alias("size"), F.lit(copy).alias("copy"))

    def carried(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["id"].alias("id"), x["key"].alias("key"), p.alias("p"))

    def pair(state: Column, x: Column) -> Column:
        c, done = state["c"], state["done"]
        s, u = c["p"] + x["p"], _uniform(c["id"], c["key"], x["id"], x["key"], F.lit(level))
        to = lambda stays, p, goes, copy: F.struct(
            carried(stays, p).alias("c"), F.array_append(done, settled(goes, copy)).alias("done")
        )
        below = F.when(u * s < c["p"], to(c, s, x, 0)).otherwise(to(x, s, c, 0))
        above = F.when(u * (2 - s) < 1 - x["p"], to(x, s - 1, c, 1)).otherwise(to(c, s - 1, x, 1))
        return F.when(s < 1, below).otherwise(above)

    grouped = units.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("size", "id", "key", "p"))).alias("units"))
    rest = F.slice("units", F.lit(2), F.greatest(F.size("units") - 1, F.lit(0)))
    return grouped.withColumn("r", F.aggregate(rest, start, pair)).select(*by, "r.c", "r.done")


def _apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is their own, and in a staged table those whose id is null or repeated with a `_key` each; None
    where there are none. Without keys, all rows of such an id would meet in one block."""
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    again = stage(counts.where("_n > 1 or doc_id is null").select(F.col("doc_id").alias("_again")))
    if not again.limit(1).count():
        return rows, None
    same, few = F.expr("doc_id <=> _again"), broadcast_few(again, COPY_ROWS)
    keyed = rows.join(few, same, "left_semi").withColumn("_key", F.monotonically_increasing_id())
    return rows.join(few, same, "left_anti"), stage(keyed)


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    alone, shared = _apart(sized(docs).drop("key"))
    sizes = alone.withColumn("key", F.lit(None).cast("long"))
    if shared is not None:
        sizes = sizes.unionByName(shared.withColumnRenamed("_key", "key"))
    return _rounded(sizes, block).drop("key")


def _rounded(sizes: DataFrame, block: int) -> DataFrame:
    """`mixture` of the rows of `sized`, with their keys. A null key leaves a hash as it is without."""
    rows = stage(sizes.withColumn("cls", _size_class(F.col("size"))))
    classes = rows.groupBy("source", "cls").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    sources = stage(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))))
    plan = stage(
        classes.alias("k")
        .join(sources.alias("s"), F.expr("k.source <=> s.source"))
        .select("k.source", "cls", "sid", "source_size", "target", F.ceil(F.col("n") / block).alias("parts"))
    )
    widest = plan.agg(F.max("parts")).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    placed = (
        rows.alias("r")
        .join(plan.alias("p"), F.expr("r.source <=> p.source and r.cls = p.cls"))
        .select("doc_id", "key", "size", "r.cls", "sid", "parts", rate.alias("rate"))
        .select("doc_id", "key", "size", "cls", "sid", "parts", whole.alias("whole"), (F.col("rate") - whole).alias("p"))
    )
    fractional = (F.col("size") > 0) & (F.col("p") > 0)
    settled = [placed.where(~fractional).select("sid", F.col("doc_id").alias("id"), "key", "size", F.lit(0).alias("copy"))]
    units = placed.where(fractional).select(
        "sid", "cls", F.pmod(F.xxhash64("doc_id", "key"), "parts").alias("part"), F.col("doc_id").alias("id"), "key", "size", "p"
    )
    level, widths = 0, []
    while True:
        by = ["sid", "cls", "part"] if not widths or widths[-1] > 1 else ["sid"]
        step = stage(_reduce(units, by, level))
        settled.append(step.select("sid", F.explode("done").alias("d")).select("sid", "d.*"))
        if by == ["sid"]:
            break
        widths.append(widest if not widths else -(-widths[-1] // block))
        part = F.floor(F.col("part") / block)
        units = step.select("sid", "cls", part.alias("part"), "c.id", "c.key", "c.size", "c.p")
        level += 1
    last = F.when(_uniform(F.col("c.id"), F.col("c.key"), F.lit(-1)) < F.col("c.p"), 1).otherwise(0)
    settled.append(step.select("sid", "c.id", "c.key", "c.size", last.alias("copy")))
    every = reduce(DataFrame.unionByName, settled)
    copies = (F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0) + F.col("copy")).cast("long")
    return (
        every.join(sources, "sid")
        .withColumn("copies", copies)
        .select(F.col("id").alias("doc_id"), "key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """`docs` with each row as often as the mix takes it, all columns kept. The copies are a narrow staged table: the texts
    meet it in one join, and are not shuffled where it is small."""
    rows = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    alone, shared = _apart(rows)
    sizes = sized(alone)
    if shared is not None:
        keyed = sized(shared.select("source", "text", F.struct("doc_id", "_key").alias("doc_id")))
        sizes = sizes.unionByName(keyed.select("doc_id.doc_id", "source", "size", F.col("doc_id._key").alias("key")))
    copies = stage(_rounded(sizes, block).where("copies > 0").select("doc_id", "key", F.col("copies").alias("_copies")))
    mine = broadcast_few(copies.where("key is null").drop("key"), COPY_ROWS)
    taken = alone.join(mine, "doc_id").select("_row", "_copies")
    if shared is not None:
        theirs = copies.where("key is not null").select(F.col("key").alias("_key"), "_copies")
        taken = taken.unionByName(shared.join(theirs, "_key").select("_row", "_copies"))
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
