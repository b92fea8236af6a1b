"""Centroid clustering (Lloyd's rounds) whose assignment is Fagin's threshold algorithm.

Every dimension has a list of the centroids in order of their value there. For a vector, each list is walked outward from
the vector's own value, nearest centroid first; a centroid met for the first time in any list is looked up in all
dimensions, which gives its exact squared distance. The frontier of a list is the squared difference to the centroid that
comes next in it, so a centroid that no list has shown yet is at least the sum of the frontiers away. The walk ends when
that sum strictly exceeds the best exact distance: then neither a nearer centroid nor one that ties can be unseen.

Components are integers and all distances and sums are exact. A round is one pass over the staged vectors: tasks assign, add
up their vectors per centroid and emit one row per centroid; what reaches the driver is k rows of sums. The centroids, which
are k x dimensions numbers whatever the input, go to the tasks with the next pass.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part; components are
cut to what keeps a squared distance within 64 bits (2 ** 27 in 64 dimensions); with fewer vectors than k there are as many centroids
as vectors; equal hashes (repeated ids) are ordered by the vectors, a null id counts as an empty decimal; repeated rows are
vectors of their own; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import session_of
from barloom.session import stage

SCALE = 64
DIM = 64
K = 16
ROUNDS = 3
SEED = 1
CHUNK = 2_048


def largest(dim: int) -> int:
    """Components up to this size keep a squared distance of `dim` dimensions within 64 bits."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v (integers, floor of scale * component) of the vectors that take part."""
    v, top = F.col("embedding"), largest(dim)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(top))), F.lit(float(-top))))
    usable = F.coalesce((F.size(v) == dim) & fine, F.lit(False))
    return vectors.where(usable).select("vec_id", F.transform(v, cut).alias("v"))


def first_centroids(whole: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hashes of `seed:vec_id`, in order."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = whole.select(F.sha2(key, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the nearest centroid (ties: the smaller) and its squared distance, by the threshold
    algorithm over all rows at once; rows whose walk has ended leave."""
    n, dim = x.shape
    k = len(centroids)
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    order = np.argsort(centroids, axis=0, kind="stable").T  # per dimension: centroids by value
    lists = np.take_along_axis(centroids.T, order, 1)
    # The nearest value at or above a row's own, and the one below it: where the two walks of each list begin.
    up = np.stack([np.searchsorted(lists[d], x[:, d]) for d in range(dim)], axis=1)
    down = up - 1
    seen = np.zeros((n, k), bool)
    rows, dims = np.arange(n), np.arange(dim)
    far = np.iinfo(np.int64).max
    for _ in range(k):
        mine = x[rows]
        above = np.where(up < k, np.abs(lists[dims, np.minimum(up, k - 1)] - mine), far)
        below = np.where(down >= 0, np.abs(mine - lists[dims, np.maximum(down, 0)]), far)
        frontier = np.minimum(above, below)
        going = (frontier * frontier).sum(axis=1) <= best[rows]
        if not going.all():
            rows, up, down, above, below = rows[going], up[going], down[going], above[going], below[going]
        if not len(rows):
            break
        rise = above <= below
        met = order[dims, np.where(rise, np.minimum(up, k - 1), np.maximum(down, 0))]
        fresh = np.zeros((len(rows), k), bool)
        np.put_along_axis(fresh, met, True, axis=1)
        fresh &= ~seen[rows]
        seen[rows] |= fresh
        for c in np.flatnonzero(fresh.any(axis=0)).tolist():
            at = rows[fresh[:, c]]
            gap = x[at] - centroids[c]
            distance = (gap * gap).sum(axis=1)
            closer = (distance < best[at]) | ((distance == best[at]) & (c < cluster[at]))
            best[at[closer]], cluster[at[closer]] = distance[closer], c
        up, down = up + rise, down - ~rise
    return cluster, best


def _rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors, the empty ones as they are."""
    k, dim = centroids.shape
    shared = whole.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x = _rows_of(b.column("v"), dim)
            for lo in range(0, len(x), CHUNK):
                part = x[lo : lo + CHUNK]
                cluster, _ = nearest(part, shared.value)
                count += np.bincount(cluster, minlength=k)
                np.add.at(total, cluster, part)
        some = np.flatnonzero(count)
        sums = pa.array([t.tolist() for t in total[some]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), sums], ["cluster", "n", "sums"])

    exact = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(dim)]
    parts = whole.select("v").mapInArrow(run, "cluster long, n long, sums array<long>")
    moved = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # k rows
        moved[r.cluster] = [int(r[f"d{d}"]) // r.n for d in range(dim)]
    return moved


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    shared = whole.sparkSession.sparkContext.broadcast(centroids)
    dim = centroids.shape[1]

    def run(batches):
        for b in batches:
            x = _rows_of(b.column("v"), dim)
            found = [nearest(x[lo : lo + CHUNK], shared.value) for lo in range(0, len(x), CHUNK)]
            cluster, distance = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (list(zip(*found)) or ((), ())))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return whole.mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid of every vector that takes part."""
    spark = session_of(vectors)
    whole = stage(whole_vectors(vectors, dim, scale))
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    for _ in range(rounds):
        centroids = _moved(whole, centroids)
    found = stage(assigned(whole, centroids))
    within = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()  # k rows
    total = sum(int(r.i) for r in within)
    most = np.iinfo(np.int64).max
    rows = [(r.cluster, min(int(r.i), most), min(total, most), centroids[r.cluster].tolist()) for r in within]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digested(vectors: DataFrame) -> DataFrame:
    """The columns of the contract: the centroid as a digest."""
    told = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clustered(vectors).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(told, 256).alias("centroid_sha256")
    )


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for `digested`, by plain comparison with every centroid."""
    apart = "list_sum(list_transform(list_zip(x, p), lambda e: (e[1] - e[2]) * (e[1] - e[2])))"
    parts = [f"""
whole as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as x
  from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda e: isfinite(e))) = {dim}),
c0 as materialized (select row_number() over (order by sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')), x) - 1 as c, x as p from whole
  qualify c < {k})"""]
    for i in range(rounds):
        parts.append(f"""a{i} as materialized (select r, any_value(x) as x, arg_min(c, (d, c)) as c from (select r, x, c, {apart} as d from whole, c{i}) group by r),
m{i} as (select c, pos, sum(v) as s, count(*) as n from (select c, unnest(x) as v, generate_subscripts(x, 1) as pos from a{i}) group by c, pos),
u{i} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as p from m{i} group by c),
c{i + 1} as materialized (select c{i}.c, coalesce(u{i}.p, c{i}.p) as p from c{i} left join u{i} using (c))""")
    parts.append(f"""final as materialized (select r, any_value(vec_id) as vec_id, arg_min(c, (d, c)) as c, min(d) as d
  from (select r, vec_id, c, {apart} as d from whole, c{rounds}) group by r)""")
    return f"""with {", ".join(parts)}
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(p, ',')) as centroid_sha256
from final join c{rounds} using (c)"""
