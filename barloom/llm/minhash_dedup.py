"""Near-duplicates by MinHash with tensored banding.

A table's key is a pair from two small collections of half keys, each half key made of `rows` minima. `halves` half keys a
side give halves x halves tables from 2 x halves x rows minima (16 x 16 tables of 8 minima from 128, not from 2,048). Two
texts share a table if they share a half key on either side; at the threshold of 0.8 that is missed with a probability of
about 2 x (1 - 0.8 ** rows) ** halves, 4e-4 with the defaults.

1. Signatures of every text in one scan. Texts with the same shingle set are one class, represented by its smallest id.
2. Half keys that only one class has are dropped; for the others the pairs are formed. In every bucket each member is
   joined to the smallest id there: a star, never all pairs. Components of the stars are candidate clusters.
3. Each cluster's full sets are compared exactly through an inverted index, inside a task for up to `block` members and in
   pairs of blocks beyond it, whatever the cluster's size. What leaves a task is a spanning forest of the confirmed links.
4. Components of the forest. No link that step 2 finds is lost, and none below the threshold is made.

Defined cases: a null text, or one without words, has an empty set, links with nothing and stays; a text with fewer than
`words` words has one shingle; of equal texts the smallest id stays; further columns are ignored by `near_duplicates` and
kept by `drop_near_duplicates`; an empty table gives an empty result. Repeated rows are one document: `near_duplicates` gives
each of them the same answer, `drop_near_duplicates` keeps one. Different texts have different ids; rows with a null id link
with nothing, have no component and stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import broadcast_few, bytes_of, in_slices, session_of
from barloom.llm.components import components
from barloom.llm.shingles import mix, shingle_sets
from barloom.session import stage

SLICE_BYTES = 1 << 20
# Ids of this many clustered documents are broadcast to pick their texts: 16 bytes each.
PICK_ROWS = 500_000


def _minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minima of each set (none empty), as (n, sets)."""
    short = np.concatenate(sets).view(np.uint64) >> np.uint64(32)
    short = short.astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64)).astype(np.uint32)
    out = np.empty((n, len(sets)), np.uint32)
    for k in range(n):
        out[k] = np.minimum.reduceat((short ^ seeds[k]) * (seeds[n + k] | np.uint32(1)), starts)
    return out


def _half_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key from every `rows` minima: (keys, sets)."""
    key = np.zeros((len(minima) // rows, minima.shape[1]), np.uint64)
    for i in range(rows):
        key = mix(key * np.uint64(31) + minima[i::rows] + np.uint64(1))
    return key


def signatures(docs: DataFrame, words: int, halves: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), and the half keys u and v (null for an empty set)."""
    session_of(docs)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
         ("u", pa.list_(pa.int64())), ("v", pa.list_(pa.int32()))]
    )

    def run(batches):
        for b in in_slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(bytes_of(b.column("text")), words)
            full = np.flatnonzero([len(s) for s in sets])
            u = v = [None] * len(sets)
            if len(full):
                keys = _half_keys(_minima([sets[i] for i in full], 2 * halves * rows), rows).T
                u, v = [None] * len(sets), [None] * len(sets)
                for i, k in zip(full.tolist(), keys):
                    u[i], v[i] = k[:halves].view(np.int64), (k[halves:] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            n = pa.array([len(s) for s in sets], pa.int64())
            cols = [b.column("doc_id"), n, pa.array(d1), pa.array(d2), pa.array(u, schema.field("u").type), pa.array(v, schema.field("v").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, u array<long>, v array<int>")


def candidate_stars(reps: DataFrame) -> DataFrame:
    """(a, b): every class with the smallest class of each bucket it is in. `reps` has rep, u and v."""
    half = reps.select("rep", "v", F.posexplode("u").alias("i", "k"))
    shared = half.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    paired = half.join(shared, ["i", "k"]).select("rep", "i", "k", F.posexplode("v").alias("j", "h"))
    keyed = paired.select("rep", F.xxhash64("i", "k", "j", "h").alias("key"))
    first = keyed.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").drop("last")
    return keyed.join(first, "key").select(F.col("rep").alias("a"), "b").where("a > b").distinct()


def _sets_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """id, cluster and full set of the clusters' members."""

    def run(batches):
        for b in in_slices(batches, "text", SLICE_BYTES):
            sets = shingle_sets(bytes_of(b.column("text")), words)
            held = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster"), held], ["id", "cluster", "set"])

    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    picked = texts.join(broadcast_few(members, PICK_ROWS), "id")
    return picked.mapInArrow(run, "id long, cluster long, set array<long>")


def _forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links that join all pairs with 100 x intersection >= percent x union, as a forest."""
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(token, kind="stable")
    posting, bound = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i in range(len(sets)):
        own = token[starts[i] : starts[i + 1]]
        lo, hi = bound[own], bound[own + 1]
        many = hi - lo > 1  # a shingle that no other set has meets none
        if not many.any():
            continue
        common = np.bincount(np.concatenate([posting[x:y] for x, y in zip(lo[many], hi[many])]), minlength=len(sets))
        common[: i + 1] = 0
        for j in np.flatnonzero((common > 0) & (100 * common >= percent * (sizes[i] + sizes - common))).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return a, b


def confirmed_links(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside the clusters. Small clusters share a task; a cluster of over `block`
    members is cut into blocks, and every pair of its blocks is a task."""
    sizes = stage(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    small = sizes.where(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-small // block))
    placed = sets.join(sizes, "cluster").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    alone = placed.where("parts = 1").select(
        "id", "set", F.lit(-1).cast("long").alias("of"), F.pmod(F.xxhash64("cluster"), F.lit(packs)).alias("x"), F.lit(0).cast("long").alias("y")
    )
    mine = F.pmod(F.xxhash64("id"), F.col("parts"))
    cut = (
        placed.where("parts > 1")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "set", F.col("cluster").alias("of"), F.least("mine", "other").alias("x"), F.greatest("mine", "other").cast("long").alias("y"))
    )

    def run(t: pa.Table) -> pa.Table:
        column = t.column("set").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        values, at = column.flatten().to_numpy(), np.asarray(column.offsets) - column.offsets[0].as_py()
        a, b = _forest(t.column("id").to_numpy(), [values[x:y] for x, y in zip(at, at[1:])], percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return alone.unionByName(cut).groupBy("of", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, halves: int = 16, rows: int = 4, block: int = 1_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) and kept, of every document."""
    session_of(docs)
    sig = stage(signatures(docs, words, halves, rows))
    classes = sig.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    keyed = sig.join(classes.select(F.col("rep").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("rep"), "u", "v")
    clusters = components(candidate_stars(keyed)).withColumnRenamed("component", "cluster")
    links = confirmed_links(stage(_sets_of(docs, stage(clusters), words)), percent, block)
    found = components(links).withColumnRenamed("id", "rep")
    reached = classes.join(found, "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("reached"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id"))
    return sig.select("doc_id", "n_shingles", "d1", "d2").join(reached, ["d1", "d2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each group, all columns kept. Of rows with the same id and text one stays; rows with a
    null id all stay.

    The ids that go, and those that occur more than once, are one narrow staged table; the texts pass a single anti join
    with it, and where it is small they are not shuffled at all. Only rows whose id repeats are looked at once more."""
    found = near_duplicates(docs, **options).where("doc_id is not null").groupBy("doc_id")
    marked = found.agg(F.min("kept").alias("_kept"), F.count(F.lit(1)).alias("_n"))
    apart = stage(marked.where("not _kept or _n > 1"))
    once = docs.join(broadcast_few(apart.select("doc_id"), PICK_ROWS), "doc_id", "left_anti").select(*docs.columns)
    again = apart.where("_kept").select("doc_id")
    if not again.limit(1).count():
        return once
    repeated = docs.join(broadcast_few(again, PICK_ROWS), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated.select(*docs.columns))
