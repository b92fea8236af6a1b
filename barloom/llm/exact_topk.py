"""Exact top-k search by inner product as columnar branch and bound.

Candidates are cut by a hash of their row into slabs of bounded size. A task holds one slab in vertical layout, dimension
block by dimension block, the dimensions of most mass first, and streams blocks of queries against it. Partial scores grow
one dimension block at a time; after each, a candidate's score can be no more than its partial score plus the product of the
remaining lengths of both vectors (Cauchy-Schwarz). Pairs whose bound is below what the query needs are dropped, and the
survivors are compacted: by whole matrix products while most survive, pair by pair after that.

What a query needs is the score of its k-th best candidate so far. Slabs are searched in rounds, each over four times as
many as all before it, and the best k of a round set the need of the next. So a query is compared with all candidates, but
only some tens of rows a round reach the shuffle for it, and the number of rounds is the logarithm of the number of slabs.
In rounds of few slabs the queries are dealt to several tasks, each with a copy of the slab. A query goes to each slab once,
so what is sent grows with queries times slabs: as the contract's queries grow with the table, a slab holds as many candidates
as a task's memory allows (`slab`, a byte a number where that is enough).

Components are integers and scores exact. Ties go to the smaller id; a slab is in order of id, so beyond k ties nothing of
the slab is kept however many vectors are equal.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors meet those of their own
length only; components are cut to what keeps a score within 64 bits; a null id is no query, and as a candidate it comes last
among ties; rows that repeat an id are candidates, and queries, of their own, and only the query's own row is left out; with
fewer than k candidates all are returned; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import session_of
from barloom.session import stage

SCALE = 64
EVERY = 20
K = 20
SLAB = 1 << 20
BLOCK_NUMBERS = 1 << 17
LEAST_SLAB = 4_096
DIMS = 16
_QUERIES = 256
_CANDIDATES = 4_096
_SPARSE = 0.15
_NONE = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, dim and v (integers, floor of scale * component) of the vectors that take part. The row keys hold as
    long as the result is staged."""
    v = F.col("embedding")
    top = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(v), F.lit(1))) / 2)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cut = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, top.cast("double")), -top.cast("double"))).cast("int")
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size(v).alias("dim"), F.transform(v, cut).alias("v")
    )


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max))


class Slab:
    """Candidates in order of id, in vertical layout: a row of `x` is a dimension, those of most mass first."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, null: np.ndarray, x: np.ndarray):
        order = np.lexsort((row, vec_id, null))
        self.row, self.vec_id, self.null = row[order], vec_id[order], null[order]
        self.largest = float(np.abs(x.astype(np.int32)).max(initial=0))
        mass = [np.square(x[:, d].astype(np.float64)).sum() for d in range(x.shape[1])]
        self.by_mass = np.argsort(-np.array(mass), kind="stable")
        self.x = np.ascontiguousarray(x[order].T[self.by_mass])
        self.cuts = list(range(0, x.shape[1], DIMS)) or [0]


def remaining(x: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Per cut the length of each vector (a column of x) in the dimensions behind that block."""
    square = np.square(x.astype(np.float64))
    return [np.sqrt(square[c + DIMS :].sum(axis=0)) for c in cuts]


def _best(owner: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The places of each owner's k best: highest score, then smallest `at`. Sorted by owner and rank."""
    order = np.lexsort((at, -score, owner))
    sorted_owner = owner[order]
    first = np.searchsorted(sorted_owner, sorted_owner, side="left")
    return order[np.arange(len(order)) - first < k]


def _survivors(mine: np.ndarray, block: np.ndarray, q_tails: list, tails: list, cuts: list[int], least: np.ndarray, k: int):
    """(query, candidate, score) of the pairs that reach `least`, of which more than the k + 1 best of a query may go
    missing if all pairs stay in view to the end."""
    part, pairs = np.zeros((len(mine), block.shape[1]), block.dtype), None
    for i, c in enumerate(cuts):
        if pairs is None:
            part += mine[:, c : c + DIMS] @ block[c : c + DIMS]
            alive = part + np.outer(q_tails[i], tails[i]) >= least[:, None]
            if alive.mean() <= _SPARSE:
                pairs = np.nonzero(alive)
                score = part[pairs]
        else:
            x, y = pairs
            score = score + np.einsum("ij,ji->i", mine[x, c : c + DIMS], block[c : c + DIMS, y])
            stays = score + q_tails[i][x] * tails[i][y] >= least[x]
            pairs, score = (x[stays], y[stays]), score[stays]
    if pairs is None:
        n = block.shape[1]
        if n > k + 1:  # the (k + 1)-th of this block, as one of them may be the query itself
            kth = np.partition(part, n - k - 1, axis=1)[:, n - k - 1]
            pairs = np.nonzero((part >= kth[:, None]) & (part >= least[:, None]))
        else:
            pairs = np.nonzero(np.ones(part.shape, bool))
        score = part[pairs]
    return *pairs, score.astype(np.int64)


def search(slab: Slab, row: np.ndarray, q: np.ndarray, need: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k best candidates of each query that score `need` or more; the query's own row is
    none. Queries and candidates are places in q and in the slab."""
    reach = slab.largest * float(np.abs(q.astype(np.int64)).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    bounds = np.float32 if kind is np.float32 else np.float64
    slack = 4 + 1e-12 * reach
    q = q[:, slab.by_mass]
    q_tails, q = [(t * (1 + 1e-5)).astype(bounds) for t in remaining(q.T, slab.cuts)], q.astype(kind)
    chunks = [slice(a, a + _QUERIES) for a in range(0, len(q), _QUERIES)]
    empty = np.zeros(0, np.int64)
    tops, floor, n = [(empty, empty, empty)] * len(chunks), need.copy(), len(slab.row)
    for lo in range(0, n, _CANDIDATES):
        block = slab.x[:, lo : lo + _CANDIDATES].astype(kind)
        tails = [t.astype(bounds) for t in remaining(block, slab.cuts)]
        for i, at in enumerate(chunks):
            least = np.where(floor[at] == _NONE, -np.inf, floor[at].astype(np.float64) - slack).astype(bounds)
            x, y, score = _survivors(q[at], block, [t[at] for t in q_tails], tails, slab.cuts, least, k)
            stays = (score >= floor[at][x]) & (row[at][x] != slab.row[y + lo])
            if not stays.any():
                continue
            x, y, score = (np.concatenate([old, new[stays]]) for old, new in zip(tops[i], (x, y + lo, score)))
            kept = _best(x, score, y, k)
            tops[i] = x, y, score = x[kept], y[kept], score[kept]
            count = np.bincount(x, minlength=len(q[at]))
            full = np.flatnonzero(count == k)
            kth = score[np.cumsum(count)[full] - 1]
            # Later candidates of the slab have larger ids, so they must beat the k-th and not tie with it.
            floor[at.start + full] = np.maximum(floor[at.start + full], kth + 1)
    found = [(x + at.start, y, score) for at, (x, y, score) in zip(chunks, tops)]
    return tuple(np.concatenate(c) for c in zip(*found))


_MEMBER = "array<struct<row: bigint, vec_id: bigint, v: array<int>, need: bigint>>"
_FOUND = "q long, query_id long, vec_id long, row long, score long"


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, vec_id, whether it is null, the matrix, and need of a list of members."""
    row, vec_id, v, need = column.flatten().flatten()
    ids = vec_id.fill_null(0).to_numpy(zero_copy_only=False)
    x = narrow(v.flatten().to_numpy(zero_copy_only=False).reshape(len(row), -1))
    return row.to_numpy(), ids, vec_id.is_null().to_numpy(zero_copy_only=False), x, need.fill_null(_NONE).to_numpy(zero_copy_only=False)


def _searched(k: int):
    def run(batches):
        key, held, slab = None, [], None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("dim", "slab", "dealt"))))
            kinds = b.column("kind").to_pylist()
            for i, now in enumerate(keys):
                if now != key:
                    key, held, slab = now, [], None
                row, vec_id, null, x, need = _members(b.column("members").slice(i, 1))
                if kinds[i] == 0:
                    held.append((row, vec_id, null, x))
                    continue
                if slab is None:
                    if not held:  # no candidate of this slab
                        continue
                    slab, held = Slab(*(np.concatenate(c) for c in zip(*held))), []
                at, c, score = search(slab, row, x, need, k)
                found_id = pa.array(slab.vec_id[c], pa.int64(), mask=slab.null[c])
                columns = [pa.array(row[at]), pa.array(vec_id[at]), found_id, pa.array(slab.row[c]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["q", "query_id", "vec_id", "row", "score"])

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE, slab: int = SLAB, least_slab: int = LEAST_SLAB) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest inner products of each row whose vec_id is divisible by
    `every`, among all other rows."""
    spark = session_of(vectors)
    whole = stage(whole_vectors(vectors, scale))
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    width = F.greatest(F.lit(16), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest(F.col("dim"), F.lit(1))))
    tasks = 2 * spark.sparkContext.defaultParallelism
    # Tasks are slabs times shares of the queries. Sent rows (candidates for each share, queries for each slab) are fewest
    # where both are as many.
    even = F.ceil(F.sqrt(tasks * F.col("n") / F.col("asked")))
    slabs = F.greatest(F.ceil(F.col("n") / slab), F.least(even, F.ceil(F.col("n") / least_slab)))
    per_dim = whole.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asked")).where("asked > 0")
    plan = stage(
        per_dim.withColumn("slabs", slabs.cast("int"))
        .withColumn("blocks", F.ceil(F.col("n") / F.col("slabs") / width).cast("int"))
        .withColumn("q_blocks", F.ceil(F.col("asked") / width).cast("int"))
        .drop("n", "asked")
    )
    widest = plan.agg(F.max("slabs"), F.sum("slabs")).first()
    placed = whole.join(plan, "dim")
    member = F.struct("row", "vec_id", "v", F.lit(None).cast("bigint").alias("need"))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks"))
    packed = placed.groupBy("dim", F.pmod(F.xxhash64("row"), F.col("slabs")).cast("int").alias("slab"), block.alias("block"))
    candidates = stage(packed.agg(F.collect_list(member).alias("members")))
    queries = placed.where(asks).withColumn("block", F.pmod(F.xxhash64("row", F.lit(2)), F.col("q_blocks")))
    best = spark.createDataFrame([], _FOUND)
    rounds = 1 + math.ceil(math.log(max(widest[0] or 1, 1), 4))
    for r in range(rounds):
        share = lambda i: F.ceil(F.col("slabs") / 4 ** (rounds - 1 - i)).cast("int") if i >= 0 else F.lit(0)
        now = plan.select("dim", share(r - 1).alias("lo"), share(r).alias("hi"), "slabs", "q_blocks").where("lo < hi")
        deal = F.least("q_blocks", F.ceil(F.lit(tasks) / (F.col("hi") - F.col("lo")))).cast("int")
        now = now.select("dim", "lo", "hi", deal.alias("deal"))
        needs = best.groupBy(F.col("q").alias("row")).agg(F.min("score").alias("need"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).drop("_n")
        asked = queries.join(needs, "row", "left").groupBy("dim", "block")
        asked = asked.agg(F.collect_list(F.struct("row", "vec_id", "v", "need")).alias("members")).join(now, "dim")
        asked = asked.withColumn("slab", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).withColumn("dealt", F.pmod("block", "deal").cast("int"))
        sought = candidates.join(now, "dim").where("slab >= lo and slab < hi")
        sought = sought.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
        parts = [x.select("dim", "slab", "dealt", F.lit(kind).alias("kind"), F.col("block").cast("long").alias("block"), F.col("members").cast(_MEMBER).alias("members"))
                 for kind, x in ((0, sought), (1, asked))]
        both = parts[0].unionByName(parts[1]).repartition(2 * max(tasks, widest[1] or 1), "dim", "slab", "dealt")
        found = both.sortWithinPartitions("dim", "slab", "dealt", "kind", "block").mapInArrow(_searched(k), _FOUND)
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
        ranked = best.select(*found.columns).unionByName(found).withColumn("rank", F.row_number().over(order))
        best = stage(ranked.where(F.col("rank") <= k))
    return best.select("query_id", "rank", "vec_id", "score")


def oracle(every: int = EVERY, k: int = K, scale: int = SCALE) -> str:
    """DuckDB SQL for `top_k`, by plain comparison with every row."""
    return f"""
with whole as materialized (select row_number() over () as r, vec_id, len(embedding) as dim,
    list_transform(embedding, lambda e: floor({scale} * cast(e as double))) as x
  from embeddings where len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
scored as (select q.r, q.vec_id as query_id, c.vec_id, c.r as cr, cast(list_inner_product(q.x, c.x) as bigint) as score
  from whole q join whole c on q.dim = c.dim and q.r <> c.r where q.vec_id % {every} = 0)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last, cr) as integer) as rank, vec_id, score
from scored qualify rank <= {k}"""
