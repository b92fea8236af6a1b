"""Top-k search, periodic runs and clustering against brute force, and their defined cases."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from barloom.llm import centroid_clustering, exact_topk, periodic_runs

NAN, INF = float("nan"), float("inf")
CLASHING = "label int, row long, dim int, v string, need long, slab int, block int, q long, score long, rank int, cluster int, distance long, n long"


def embeddings(spark, rows):
    full = [(i, v, 1, 7, 7, "x", 7, 7, 7, 7, 7, 7, 7, 7, 7) for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<float>, {CLASHING}")


def whole(v, scale=64):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def odd_vectors(dim):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=dim).tolist()) for i in range(300)]
    same = rng.normal(size=dim).tolist()
    rows += [(1_000 + i, same) for i in range(200)]  # a third of all rows are one vector
    rows += [(40, same), (40, same), (None, same), (None, rng.normal(size=dim).tolist())]
    bad = [None, [], [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [NAN] + [1.0] * (dim - 1), [INF] * dim, [-INF] + [0.0] * (dim - 1)]
    rows += [(2_000 + 20 * i, v) for i, v in enumerate(bad)]
    rows += [(3_000, [3e38] * dim), (3_020, [-3e38] * dim), (3_040, [0.0] * dim), (3_060, [1e-45] * dim)]
    return rows


def brute_top(rows, every=20, k=20):
    out = []
    top = lambda v: int(np.sqrt(2.0**62 / max(len(v), 1)) / 2)
    kept = [(i, [max(-top(v), min(top(v), x)) for x in whole(v)]) for i, v in rows if usable(v)]
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        found = [(-sum(a * b for a, b in zip(q, x)), j is None, j or 0, j) for n, (j, x) in enumerate(kept) if n != at and len(x) == len(q)]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(found)[:k])]
    return collections.Counter(out)


@pytest.mark.parametrize(("dim", "slab", "least"), [(8, 65_536, 4_096), (8, 50, 20), (40, 100, 30)])
def test_top_k_against_brute_force(spark, dim, slab, least):
    rows = odd_vectors(dim)
    got = exact_topk.top_k(embeddings(spark, rows), slab=slab, least_slab=least)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == brute_top(rows)


def test_top_k_of_few_and_none(spark):
    assert exact_topk.top_k(embeddings(spark, [])).count() == 0
    assert exact_topk.top_k(embeddings(spark, [(20, [1.0, 2.0])])).count() == 0
    assert exact_topk.top_k(embeddings(spark, [(21, [1.0, 2.0]), (22, [1.0, 2.0])])).count() == 0
    got = exact_topk.top_k(embeddings(spark, [(20, [1.0, 0.5]), (3, [0.5, -1.0]), (0, [])])).collect()
    assert [tuple(r) for r in got] == [(20, 1, 3, 64 * 32 + 32 * -64)]


def test_bounds_drop_nothing_at_any_width():
    rng = np.random.default_rng(1)
    for kind, size in ((np.float32, 40), (np.float64, 1 << 20), (np.int64, 1 << 27)):
        x = rng.integers(-size, size + 1, (3_000, 37))
        slab = exact_topk.Slab(np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), bool), x)
        rows = rng.integers(0, len(x), 40)
        q, c, score = exact_topk.search(slab, rows, x[rows], np.full(40, np.iinfo(np.int64).min), 7)
        every = x[rows] @ x.T
        every[np.arange(40), rows] = -np.iinfo(np.int64).max
        for i in range(40):
            want = sorted(zip((-every[i]).tolist(), range(len(x))), key=lambda p: (-every[i][p[1]], p[1]))[:7]
            assert [(-s, j) for s, j in want] == list(zip(score[q == i].tolist(), slab.row[c[q == i]].tolist())), kind


def brute_runs(w, least):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, m, p) for (s, m), p in found.items())


def made_up(rng):
    """Random words of few letters, loops with slips, and loops in loops."""
    n, kind = rng.randint(0, 70), rng.random()
    if kind < 0.4:
        return [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(n)]
    loop = [rng.choice("ab") for _ in range(rng.randint(1, 13))]
    w = (loop * 70)[:n]
    if kind < 0.7:
        for _ in range(rng.randint(0, 3)):
            if w:
                w[rng.randrange(len(w))] = rng.choice("abc")
        return w
    w = []
    while len(w) < n:
        w += loop * rng.randint(1, 4) + [rng.choice("abc")] * rng.randint(0, 2)
        w += w if rng.random() < 0.3 else []
    return w[:140]


@pytest.mark.parametrize("least", [1, 2, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(40):
        docs = [[c.encode() for c in made_up(rng)] for _ in range(40)]
        r = periodic_runs.find_runs(*periodic_runs.numbered(docs), least)
        got = collections.defaultdict(list)
        for d, *run in zip(*(x.tolist() for x in (r.doc, r.start, r.length, r.period))):
            got[d].append(tuple(run))
        assert [got[k] for k in range(len(docs))] == [brute_runs(w, least) for w in docs]


def test_long_runs_of_one_word_and_of_a_long_period():
    n = 200_000
    one, long = [b"a"] * n, [str(i % 70_001).encode() for i in range(n)]
    r = periodic_runs.find_runs(*periodic_runs.numbered([one, long]))
    assert [x.tolist() for x in (r.doc, r.start, r.length, r.period)] == [[0, 1], [0, 0], [n, n], [1, 70_001]]


def brute_document(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(b"" if i is None else str(i).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = brute_runs(w, 12)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(runs), *four, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_of_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(made_up(rng))) for i in range(400)]
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 300)))) for i in range(400, 600)]
    rows += [(None, None), (None, ""), (None, "a b " * 30), (601, None), (602, " \t\n"), (603, "é ü " * 20), (604, "x" * 10_000), (7, "a b c " * 9), (7, "a b c " * 9)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, "s") for i, t in rows], "doc_id long, text string, start long, length int, n_runs int, source string")
    got = periodic_runs.looped_runs(docs)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_document(i, t) for i, t in rows)
    plain = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}[7]
    assert (plain.starts, plain.lengths, plain.periods, plain.collapsed) == ([0], [27], [3], "a b c")
    assert periodic_runs.looped_runs(docs.limit(0)).count() == 0


def test_threshold_walk_against_every_distance():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k, dim, n, m = (int(rng.integers(1, top)) for top in (17, 65, 200, 65))
        x, c = rng.integers(-m, m + 1, (n, dim)), rng.integers(-m, m + 1, (k, dim))
        every = ((x[:, None] - c) ** 2).sum(axis=2)
        cluster, distance = centroid_clustering.nearest(x, c)
        assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def brute_clusters(rows, k, rounds):
    top = centroid_clustering.largest(64)
    kept = [(i, [max(-top, min(top, x)) for x in whole(v)]) for i, v in rows if usable(v) and len(v) == 64]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda: [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = place()
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, of) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    of = place()
    far = [apart(v, centroids[c]) for (_, v), c in zip(kept, of)]
    within = collections.Counter()
    for c, d in zip(of, far):
        within[c] += d
    cap = 2**63 - 1
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, c, d, min(within[c], cap), min(sum(far), cap), told[c]) for (i, _), c, d in zip(kept, of, far))


def test_clusters_against_brute_force(spark):
    rows = odd_vectors(64)
    got = centroid_clustering.digested(embeddings(spark, rows))
    assert collections.Counter(map(tuple, got.collect())) == brute_clusters(rows, 16, 3)
    few = rows[:5]
    assert collections.Counter(map(tuple, centroid_clustering.digested(embeddings(spark, few)).collect())) == brute_clusters(few, 16, 3)
    none = centroid_clustering.digested(embeddings(spark, []))
    assert none.columns == got.columns and none.count() == 0
