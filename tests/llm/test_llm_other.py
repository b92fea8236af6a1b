"""Vectors, pages, the classifier, the registered queries against their SQL, and the pipeline."""

import collections
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import embedding_dedup, entries, minhash_dedup, quality_classifier, quality_rules, url_filters

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entries.SQL))
def test_query_against_sql(spark, con, name):
    df = entries.QUERIES[name](spark, SF)
    rel = con.execute(entries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert collections.Counter(map(tuple, df.select(*names).collect())) == collections.Counter(rel.fetchall())


def test_hadamard_is_a_rotation():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_hash_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    (ma, pa), (mb, pb) = (embedding_dedup.polytope_codes(x, 6, 2, 2) for x in (a, b))
    met = (ma == mb) | (pa == mb[:, :, None]).any(2) | (pb == ma[:, :, None]).any(2)
    assert met.any(1).mean() >= 0.998
    for n in (100, 50_000, 10_000_000):
        per = embedding_dedup.hashes_per_table(n, 64)
        tables = embedding_dedup.tables_for(64, 0.95, per, embedding_dedup.PROBES, embedding_dedup.MISS)
        assert 128**per >= n
        (ma, pa), (mb, pb) = (embedding_dedup.polytope_codes(x, tables, per, embedding_dedup.PROBES) for x in (a, b))
        met = (ma == mb) | (pa == mb[:, :, None]).any(2) | (pb == ma[:, :, None]).any(2)
        assert met.any(1).mean() >= 0.998


def test_a_vector_meets_as_few_others_in_a_large_table():
    rng = np.random.default_rng(2)
    met = []
    for n in (4_000, 16_000, 64_000, 128_000):
        v = rng.normal(size=(n, 32))
        per = embedding_dedup.hashes_per_table(n, 32)
        main, probe = embedding_dedup.polytope_codes(v, 1, per, embedding_dedup.PROBES)
        keys, size = np.unique(main, return_counts=True)
        asked = np.minimum(np.searchsorted(keys, probe.ravel()), len(keys) - 1)
        met.append(((size * (size - 1)).sum() + size[asked][keys[asked] == probe.ravel()].sum()) / n)
    assert max(met) < 8 and met[-1] < met[-2]


def test_vectors_without_ids(spark):
    e = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(e).collect())
    assert got == [(0, 0, None, True), (0, 0, None, True), (5, 1, 5, True), (7, 1, 5, False)]


def brute_links(v, threshold):
    n = len(v)
    ok = [x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x) for x in v]
    unit = [np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)) if o else None for x, o in zip(v, ok)]
    near = [[i != j and ok[i] and ok[j] and len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= threshold for j in range(n)] for i in range(n)]
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in range(n) if near[i][j])]) for i in range(n)]
        if new == label:
            return [sum(x) for x in near], label
        label = new


@pytest.mark.parametrize(("block", "tables"), [(2_000, None), (9, None), (9, 12)])
def test_vectors_against_brute_force(spark, block, tables):
    rng = np.random.default_rng(8)
    v = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [1.0] * 16, [2.0] * 16, [1.0] * 16, [1.0] * 3]
    center = rng.normal(size=16)
    v += [(center + 0.28 * s * rng.normal(size=16)).tolist() for s in (0.3, 0.6, 0.9, 1.2) for _ in range(25)]
    v += rng.normal(size=(20, 16)).tolist()
    rows = [(i, x, i % 3, "x") for i, x in enumerate(v)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weight int, main string")
    links, label = brute_links(v, 0.95)
    assert sum(links) > 200
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(e, tables=tables, block=block).collect()}
    assert len(got) == len(v)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (links[i], label[i], label[i] == i) for i in range(len(v)))


def test_vectors_empty_and_repeated(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(e).count() == 0
    e = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(e).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


PAGES = "page_id long, url string, html string, host string, trust double"


def test_url_cases(spark):
    rows = [
        (1, None, None), (2, "no scheme", ""), (3, "HTTP://A.Org", "x"), (4, "http://a.org/", None), (5, "x://Example.ORG/en/12?q#f", None),
        (6, "https://example.org/es/?u=http://z.com/fr/", None), (7, "http://b.com/fr/x", None), (8, "http://b.com/de/x", None),
        (9, "http://com/fr/", None), (10, "http://xcom/fr/", None), (10, "http://xcom/fr/", None), (11, "http://q.net#a/b", None),
    ]
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(pages).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.org", "", None, "allow") and got[4] == ("a.org", "/", "org/", "allow")
    assert got[5] == ("example.org", "/en/12", "example.org/en/1", "block") and got[6] == ("example.org", "/es/", "example.org/es/", "block")
    assert got[7][2:] == ("com/fr/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == ("com/fr/", "allow")
    assert got[10] == ("xcom", "/fr/", None, "allow") and got[11] == ("q.net", "", None, "allow")
    assert url_filters.filter_urls(pages).count() == len(rows)
    assert url_filters.filter_urls(pages.limit(0)).count() == 0


def test_distrust_follows_links_back(spark):
    link = lambda *to: "".join(f'<a href="http://{t}/">x</a>' for t in to)
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://farm.net/a", link("bad.com")), (3, "http://good.com/fr/1", link("liked.net")),
            (4, "http://liked.net/a", ""), (5, "http://up.net/a", link("farm.net", "FARM.net"))]
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], PAGES)
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block"}


def test_url_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    """A link farm around one blocked page, with and without a million blocked pages that have nothing to do with it."""
    rows = [(-1, "http://bad.com/de/1", ""), (-2, "http://good.com/fr/1", '<a href="http://liked.net/">x</a>'), (-3, "http://liked.net/a", "")]
    rows += [(i, f"http://farm{i}.net/a", '<a href="http://bad.com/">x</a>') for i in range(1_000)]
    small = spark.createDataFrame([(*r, "x", 1.0) for r in rows], PAGES)
    more = spark.range(1_000_000).select(
        (F.col("id") + 10_000).alias("page_id"), F.lit("http://other.com/de/x").alias("url"), F.lit("").alias("html"),
        F.lit("x").alias("host"), F.lit(1.0).alias("trust"),
    )
    want = {r[0]: "allow" if r[0] in (-2, -3) else "block" for r in rows}
    for pages in (small, small.unionByName(more)):
        got = url_filters.filter_urls(pages).where("page_id < 10000").collect()
        assert {r.page_id: r.verdict for r in got} == want


def test_distrust_follows_chains_to_their_end(spark):
    """Thirty hosts, each linking to the one before; the first links to a blocked one."""
    rows = [(0, "http://h0.com/de/1", "")] + [(i, f"http://h{i}.com/a", f'<a href="http://h{i - 1}.com/">x</a>') for i in range(1, 31)]
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], PAGES)
    assert {r.verdict for r in url_filters.filter_urls(pages).collect()} == {"block"}


def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_classifier_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b c " * 50_000, 0.5), (3, "a b c", 0.5), (4, "!!", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), labels).count() == 0
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 5
    one = quality_classifier.fit_texts([b"x y z."] * 2, [1, 0]).score([b"x y z.", b""])
    assert one == pytest.approx([0.5, 0.5])


def test_pipeline_against_brute_force(spark):
    """Each stage of the pipeline on what the one before kept, against its own plain version."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece
    from test_llm_texts import brute_components

    from barloom.session import stage

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup", "mix_sources", "sentencepiece"]
    docs = corpus_pipeline.table(spark, SF, "documents")
    kept = {r.doc_id: r.text for r in docs.collect()}
    columns, last, out = docs.columns, len(corpus_pipeline.STAGES) - 1, None
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        before, texts = docs, kept
        docs = stage(f(spark, docs, SF))
        rows = docs.collect()
        assert i == last or docs.columns == columns
        got = collections.Counter(r.doc_id for r in rows)
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
            train = sorted((r.doc_id, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in texts)
            m = quality_classifier.fit_texts([texts[d].encode() for d, _ in train], [q for _, q in train])
            want = {d for d, s in zip(texts, m.score([t.encode() for t in texts.values()])) if s >= 0.3}
        elif name == "quality_rules":
            c = duckdb.connect()
            held = before.toPandas()  # noqa: F841
            c.execute("create view documents as select * from held")
            rel = c.execute(f"select doc_id from ({quality_rules.oracle()}) where kept")
            want = {r[0] for r in rel.fetchall()}
        elif name == "minhash_near_dedup":
            want = {i for i, c in brute_components(texts, 5, 80)[0].items() if i == c}
        elif name == "mix_sources":
            assert max(got.values()) <= 2 and set(got) <= set(texts)
            size = {d: len(t.encode().split()) for d, t in texts.items()}
            assert sum(size[d] * n for d, n in got.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.15)
            copies, want = got, set(got)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert got == copies and all(r.ids == sp.encode(texts[r.doc_id]) and r.restored for r in rows)
            want, out = set(got), rows
        assert set(got) == want and (i >= 3 or max(got.values()) == 1)
        kept = {d: texts[d] for d in got}
    assert 0 < len(kept) and len(corpus_pipeline.run(spark, SF).collect()) == len(out)


def test_operators_are_imported_by_nothing_else():
    for top, _, names in os.walk(os.path.join(ROOT, "barloom")):
        for n in names:
            if n.endswith(".py") and not top.endswith("llm"):
                with open(os.path.join(top, n)) as f:
                    assert "barloom.llm" not in f.read()


def test_main_paths_are_native(spark):
    """The plans of the native operators hold no Python node."""
    for name in ("op1_quality_rules", "op3_url_filters", "op5_license_scan", "op9_mix_sources"):
        plan = entries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name


def test_labels_and_text_cases_do_not_collect(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 12, "s", "en", 3) for i in range(30)], "doc_id long, text string, source string, lang string, n_chars int")
    assert minhash_dedup.drop_near_duplicates(docs.withColumn("u", F.lit(1))).count() == 30


def test_classifier_of_repeated_and_null_ids(spark):
    texts = {i: ("Some good words, in a row." if i % 2 else "bad!!! ### bad") * (i % 5 + 1) for i in range(1, 60)}
    rows = [(i, t) for i, t in texts.items()] + [(1, texts[1])] * 300 + [(None, texts[3]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    once = quality_classifier.scored(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), labels)
    want = {r.doc_id: r.score for r in once.collect()}
    got = quality_classifier.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score == pytest.approx(want[r.doc_id]) for r in got if r.doc_id)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]


def brute_scores(texts, labels, queries, terms, rank, neighbours):
    """The classifier written plainly: counts by loops, a full decomposition, every cosine, votes one by one."""
    def grams(t):
        shape = []
        for ch in t:
            c = ord("a") if 97 <= ch <= 122 or ch >= 128 else ord("A") if 65 <= ch <= 90 else ord("0") if 48 <= ch <= 57 else 32 if ch in b"\t\x0b\x0c\r " else ch
            if not (shape and shape[-1] == c and c in (97, 65, 48)):
                shape.append(c)
        out = np.zeros(terms)
        padded = shape + [0] * 4
        for k in range(len(shape)):
            code = 0
            for c in padded[k : k + 4]:
                code = (code * 257 + c) % 2**64
            out[(code * 0x9E3779B97F4A7C15 % 2**64 >> 52) % (terms - 1)] += 1
        words = t.split()
        out[terms - 1] = sum(words[i] == words[i - 1] == words[i - 2] for i in range(2, len(words)))
        return out

    counts = np.array([grams(t) for t in texts])
    rarity = np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=-1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=-1, keepdims=True) > 0)
    weighted = unit(np.log1p(counts) * rarity)
    axes = np.linalg.svd(weighted, full_matrices=False)[2][:rank].T
    known = unit(weighted @ axes)
    out = []
    for t in queries:
        near = known @ unit(unit(np.log1p(grams(t)) * rarity) @ axes)
        top = sorted(range(len(texts)), key=lambda i: -near[i])[:neighbours]
        votes = [max(near[i], 0) ** 4 for i in top]
        out.append(sum(v * labels[i] for v, i in zip(votes, top)) / sum(votes) if sum(votes) else np.mean(labels))
    return out


def test_classifier_against_a_plain_version():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcXYZ09.,!# \n\t"), rng.integers(1, 9)))
    texts = [" ".join(word() for _ in range(rng.integers(1, 40))).encode() for _ in range(50)]
    texts += [b" ".join([word().encode()] * int(rng.integers(1, 40))) for _ in range(10)]
    labels = rng.integers(0, 2, 60).tolist()
    model = quality_classifier.fit_texts(texts, labels, terms=256, rank=60, neighbours=5)
    queries = [" ".join(word() for _ in range(20)).encode() for _ in range(30)] + [b"", b"a", b"so " * 30, b"so so good"]
    assert model.score(queries) == pytest.approx(brute_scores(texts, labels, queries, 256, 60, 5), abs=2e-3)


def test_classifier_learns_that_words_repeat():
    """Texts of one word over and over have the shape of good ones; what tells them apart is that the word is the same."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.integers(20, 200))).encode()
    bad = lambda: b" ".join([word().encode()] * int(rng.integers(20, 200)))
    texts = [good() for _ in range(200)] + [bad() for _ in range(20)]
    model = quality_classifier.fit_texts(texts, [1] * 200 + [0] * 20)
    assert min(model.score([good() for _ in range(50)])) >= 0.3 > max(model.score([bad() for _ in range(50)]))
    # A word that stands twice is nothing to a good text.
    assert model.score([good() + b" on on " + good()])[0] >= 0.3
    assert [quality_classifier.repeats(t) for t in (b"", b"a", b"a a", b"a a a", b"a\ta\na a b b b")] == [0, 0, 0, 1, 3]
