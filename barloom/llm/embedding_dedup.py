"""Near-duplicate vectors by cross-polytope hashing (Andoni et al., "Practical and Optimal LSH for Angular Distance").

A hash rotates the vector pseudo-randomly, by three rounds of sign flips and a fast Hadamard transform, and takes the axis
it is nearest to, with its sign. A table's bucket is named by `per_table` of them. Besides its own bucket a vector probes
the `probes` next likely ones of each table, those where a hash falls to the second or third nearest axis by least.

1. Equal vectors are one class, represented by the smallest id and weighted by their number.
2. Each class goes to its buckets. In a bucket all pairs of a member and a member or prober are compared by exact cosine in
   double precision, as blocked matrix products; a bucket of over `block` rows is cut into blocks, and every pair of its
   blocks is a task. A pair that meets in several buckets counts in the first only. What leaves a task is a sum of links
   per vector and a spanning forest, never the pairs.
3. Links are summed, and components follow from the forests.

The hashes per table follow the logarithm of the number of classes, so that there are at least as many buckets as classes
and a vector meets as many unrelated ones in a table of millions as in one of thousands. The number of tables follows from
a stated probability `miss` of missing a pair at the threshold: how often such pairs meet in one table is measured on random
pairs of the vectors' dimension, in the tasks, and tables are independent. Only rows of buckets that two vectors share carry
their vectors.

Defined cases: a vector that is null, empty, zero or has null or non-finite components has no links and is kept; vectors of
different length never meet; repeated vectors link with each other, repeated rows too; further columns are ignored; an empty table gives an
empty result. Rows without an id link with nothing, have no component and are kept.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import session_of
from barloom.llm.components import components
from barloom.session import stage

SEED = 7
MISS = 5e-4
PROBES = 2
_TRIALS = 1_000
BLOCK = 2_000
PACK_ROWS = 20_000
_CHUNK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def polytope_codes(v: np.ndarray, tables: int, per_table: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each vector in each table, (n, tables), and the buckets it probes, (n, tables, probes)."""
    n, dim = v.shape
    d = max(4, 1 << (dim - 1).bit_length())
    padded = np.zeros((n, d), np.float32)
    padded[:, :dim] = v / np.linalg.norm(v, axis=1, keepdims=True)
    main = np.empty((n, tables), np.int64)
    probe = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        axes, gaps = [], []
        for k in range(per_table):
            signs = np.random.default_rng((SEED, t, k)).integers(0, 2, (3, d)).astype(np.float32) * 2 - 1
            x = padded
            for s in signs:
                x = hadamard(x * s)
            size = np.abs(x)
            top = np.argpartition(-size, 2, axis=1)[:, :3]
            order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
            top = np.take_along_axis(top, order, 1)
            near = np.take_along_axis(size, top, 1)
            axes.append(2 * top + (np.take_along_axis(x, top, 1) < 0))
            gaps.append(near[:, :1] - near[:, 1:])
        place = [(2 * d) ** k for k in range(per_table)]
        main[:, t] = sum(a[:, 0] * p for a, p in zip(axes, place))
        moved = np.concatenate([(a[:, 1:] - a[:, :1]) * p for a, p in zip(axes, place)], axis=1)
        pick = np.argsort(np.concatenate(gaps, axis=1), axis=1, kind="stable")[:, :probes]
        probe[:, t] = main[:, t : t + 1] + np.take_along_axis(moved, pick, 1)
    return main, probe


def hashes_per_table(classes: int, dim: int) -> int:
    """So many that a table has four buckets for each class at least (classes are not spread evenly)."""
    d = max(4, 1 << (dim - 1).bit_length())
    return max(1, min(62 // (2 * d).bit_length(), math.ceil(math.log(4 * max(classes, 1)) / math.log(2 * d))))


def meet_rate(dim: int, threshold: float, per_table: int, probes: int, trials: int = _TRIALS) -> float:
    """How often random pairs at the threshold share a bucket of one table, own or probed."""
    rng = np.random.default_rng(SEED)
    a, b = rng.normal(size=(2, trials, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    (m, p), (n, q) = (polytope_codes(x, 4, per_table, probes) for x in (a, b))
    return float(((m == n) | (p == n[:, :, None]).any(2) | (q == m[:, :, None]).any(2)).mean())


@cache
def tables_for(dim: int, threshold: float, per_table: int, probes: int, miss: float) -> int:
    """So many that a pair at the threshold is missed by all with a probability of `miss` at most."""
    if dim < 2:
        return 1
    rate = min(max(meet_rate(dim, threshold, per_table, probes), 0.01), 0.999)
    return max(2, math.ceil(math.log(miss) / math.log(1 - rate)))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(v: Column) -> Column:
    """A vector that can have a direction."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _coded(classes: DataFrame, n: int, threshold: float, miss: float, probes: int, tables: int | None) -> DataFrame:
    """rep, weight, v and its codes: `main` (tables) and `probe` (tables x probes, flat). There are n classes."""
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches):
        for b in batches:
            sizes = np.asarray(b.column("v").value_lengths())
            main, probe = [None] * len(sizes), [None] * len(sizes)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                dim = int(size)
                per_table = hashes_per_table(n, dim)
                t = tables or tables_for(dim, threshold, per_table, probes, miss)
                m, p = polytope_codes(_matrix(b.column("v").take(pa.array(rows))), t, per_table, probes)
                for i, r in enumerate(rows.tolist()):
                    main[r], probe[r] = m[i], p[i].ravel()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(main, pa.list_(pa.int64())), pa.array(probe, pa.list_(pa.int64()))],
                [*b.schema.names, "main", "probe"],
            )

    return classes.select("rep", "weight", "v").mapInArrow(
        run, f"rep long, weight long, v {kind}, main array<bigint>, probe array<bigint>"
    )


def _bucketed(coded: DataFrame, block: int) -> DataFrame:
    """One row per class and bucket (and pair of blocks) where it can meet another: bucket, t, own (its own bucket or
    probed), x, y and mine (blocks), and `task`, by which rows are grouped."""
    dim, per = F.size("v").alias("dim"), (F.size("probe") / F.size("main")).cast("int").alias("per")
    own = coded.select("rep", dim, F.posexplode("main").alias("t", "code"), F.lit(True).alias("own"))
    asked = coded.select("rep", dim, per, F.posexplode("probe").alias("i", "code"))
    asked = asked.select("rep", "dim", F.floor(F.col("i") / F.col("per")).cast("int").alias("t"), "code", F.lit(False).alias("own"))
    keys = own.unionByName(asked).select("rep", F.xxhash64("dim", "t", "code").alias("bucket"), F.col("t").cast("byte").alias("t"), "own")
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any")).where("n > 1 and any").drop("any")
    placed = keys.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cut = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = cut.select("rep", F.col("t").cast("int").alias("t"), "own", "bucket", "parts", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    return rows.join(coded, "rep")


def _links(ids, weight, v, main, probe, own, mine, t, threshold):
    """Weighted links per row and a forest, of one bucket (or pair of its blocks)."""
    n, tables = main.shape
    per = probe.shape[1] // tables
    probe = probe.reshape(n, tables, per)
    total, label, a, b = np.zeros(n, np.int64), np.arange(n), [], []
    two = mine.min() != mine.max()
    for lo in range(0, n, _CHUNK):
        i, j = np.nonzero(v[lo : lo + _CHUNK] @ v.T >= threshold)
        i += lo
        good = (i < j) & (own[i] | own[j])
        if two:  # a block with itself is another task
            good &= mine[i] != mine[j]
        i, j = i[good], j[good]
        for s in range(t + 1):
            p, q = main[i, s], main[j, s]
            to_j = (probe[j, s] == p[:, None]).any(1)
            to_i = (probe[i, s] == q[:, None]).any(1)
            if s < t:
                keep = ~((p == q) | to_i | to_j)
            else:  # they may meet in either's own bucket: the smaller code counts
                here = np.where(own[i], p, q)
                keep = ~(to_i & to_j) | (here == np.minimum(p, q))
            i, j = i[keep], j[keep]
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
        pair = np.unique(label[i] * n + label[j])
        parent = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for x, y in zip((pair // n).tolist(), (pair % n).tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(ids[x])
                b.append(ids[y])
        if parent:
            new = np.arange(n)
            for x in parent:
                new[x] = find(x)
            label = new[label]
    return total, a, b


def _compared(rows: DataFrame, threshold: float, packs: int) -> DataFrame:
    """(a, b, n): with b null n links of a, else a link of the forest."""
    alone = F.col("parts") == 1
    task = rows.withColumn("task", F.when(alone, F.pmod("bucket", F.lit(packs))).otherwise(F.xxhash64("bucket", "x", "y")))
    task = task.withColumn("alone", alone)

    def run(t: pa.Table) -> pa.Table:
        order = np.lexsort((t.column("rep").to_numpy(), t.column("bucket").to_numpy()))
        t = t.take(pa.array(order))
        bucket, table = t.column("bucket").to_numpy(), t.column("t").to_numpy()
        ids, weight, mine = (t.column(c).to_numpy() for c in ("rep", "weight", "mine"))
        own = t.column("own").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out_a, out_b, out_n = [], [], []
        for lo, hi in zip(starts, [*starts[1:], len(bucket)]):
            part = t.slice(lo, hi - lo)
            v = _matrix(part.column("v"))
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            main, probe = (_matrix(part.column(c)).astype(np.int64) for c in ("main", "probe"))
            s = slice(lo, hi)
            total, a, b = _links(ids[s], weight[s], v, main, probe, own[s], mine[s], int(table[lo]), threshold)
            some = np.flatnonzero(total)
            out_a += [*ids[s][some].tolist(), *a]
            out_b += [*[None] * len(some), *b]
            out_n += [*total[some].tolist(), *[None] * len(a)]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "n": pa.array(out_n, pa.int64())})

    return task.groupBy("alone", "task").applyInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    tables: int | None = None,
    probes: int = PROBES,
    miss: float = MISS,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of (vec_id, embedding)."""
    session_of(vectors)
    v = F.col("embedding")
    able = usable(v) & F.col("vec_id").isNotNull()
    digest = [F.when(F.col("ok"), F.xxhash64(F.lit(i), v)).alias(f"d{i}") for i in (1, 2)]
    rows = vectors.select("vec_id", v, able.alias("ok")).select("vec_id", "ok", *digest, v)
    classes = stage(
        rows.where("ok").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    )
    reps = classes.join(vectors.select(F.col("vec_id").alias("rep"), v.alias("v")), "rep").dropDuplicates(["rep"])
    coded = stage(_coded(reps, classes.count(), threshold, miss, probes, tables))
    met = stage(_bucketed(coded, block))
    packs = max(1, -(-met.where("parts = 1").count() // PACK_ROWS))
    found = stage(_compared(met, threshold, packs))
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    grown = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "rep")
    known = classes.join(links, "rep", "left").join(grown, "rep", "left").select(
        "d1",
        "d2",
        (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("reached"),
    )
    component = F.coalesce("reached", "vec_id")
    return rows.select("vec_id", "d1", "d2").join(known, ["d1", "d2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
