"""Text operators against brute force and the libraries, and their defined cases."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import license_scan, lm_scoring, minhash_dedup, mixing, quality_rules, sentencepiece_codec, token_counts
from barloom.llm.components import components
from barloom.llm.shingles import shingle_sets

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# Names that operators use inside, as further columns.
CLASHING = "text string, source string, label string, rep long, kept boolean, n_words long, size long, target double, block int, score double, copies int, failed long, cluster long, w string, id long"
LONG = "the quick brown fox jumps over a lazy dog " * 4_000


def documents(spark, rows):
    """(doc_id, text, source) with the further columns filled with something."""
    full = [(i, t, s, "x", i, False, -1, -1, -1.0, -1, -1.0, 7, -1, -1, "y", -1) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, " + CLASHING)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, one word, very long, repeated rows, equal texts, special strings, unusual characters."""
    rows = [
        (1, None, None), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", "a"), (4, "word", "b"), (5, LONG, "b"), (6, "same text here again", "a"),
        (6, "same text here again", "a"), (7, "Same Text here again", None), (8, "<|endoftext|> <s> </s> ▁ x", "c"),
        (9, "漢字 😀 \U0001f9ff ɐ͸ \x00 \x85   naïve Éa", "c"), (10, "MIT License mit license", "c"),
    ]
    return documents(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def words(text):
    return (text or "").encode().lower().split()


def test_empty_tables(none):
    assert quality_rules.judged(none).count() == 0
    assert quality_rules.ablations(quality_rules.ledger(none)).count() == 0
    assert lm_scoring.fold_scores(none).count() == 0
    assert token_counts.token_counts(none, BPE).count() == 0
    assert license_scan.scanned(none).count() == 0
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert mixing.mixture(none).count() == 0
    assert sentencepiece_codec.encoded(none, PIECES).count() == 0
    for f in (quality_rules.keep_passing, minhash_dedup.drop_near_duplicates, mixing.mix):
        assert f(none).columns == none.columns and f(none).count() == 0


def test_rules_defined_cases(odd):
    got = {r.doc_id: r for r in quality_rules.judged(odd).collect()}
    assert all((got[i].n_words, got[i].n_lines, got[i].base_failed, got[i].kept) == (0, 0, True, False) for i in (1, 2, 3))
    assert got[5].n_words == 36_000 and got[5].n_repeat_words == 36_000 and not got[5].kept
    assert quality_rules.judged(odd).count() == odd.count()
    assert quality_rules.keep_passing(odd).columns == odd.columns


def test_rules_repeat_words(spark):
    rows = [(1, "a b c d e x a b c d e f", "s"), (2, "a " * 9 + "z", "s"), (3, "l one\nl one\r\nl one\n\n \nl one", "s"), (4, "a b c d", "s")]
    got = {r.doc_id: r for r in quality_rules.judged(documents(spark, rows)).collect()}
    assert [got[i].n_repeat_words for i in (1, 2, 3, 4)] == [10, 9, 8, 0]
    assert [got[3].n_lines, got[3].n_dup_lines] == [4, 2]


def test_ablations(odd):
    rows = quality_rules.ledger(odd).cache()
    bit = {r: 1 << i for i, r in enumerate(quality_rules.RULES)}
    failed = [r.failed for r in rows.collect()]
    for r in quality_rules.ablations(rows).collect():
        m = quality_rules.mask(r.policy)
        assert r.n_kept == sum(f & m == 0 for f in failed)
        assert r.n_kept_without == sum(f & m & ~bit[r.rule] == 0 for f in failed)
        assert r.n_failing == sum(f & bit[r.rule] != 0 for f in failed)


def test_filter_on_the_ledger_ends(odd):
    assert quality_rules.ledger(odd).where("failed = 0").count() == 0


def brute_ppm(texts, held):
    """Word counts and a function from text to log10 probability, symbol by symbol."""
    counts, trie = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, t in texts:
        if held(i):
            continue
        counts.update([*t.split(), b""])
        s = b"\xff" * 4 + t + b"\xfe"
        for k in range(4, len(s)):
            for o in range(5):
                trie[s[k - o : k]][s[k]] += 1

    def symbol(ctx, y):
        seen, total = set(), 0.0
        for o in range(4, -1, -1):
            c = trie.get(ctx[4 - o :])
            if not c:
                continue
            left = {a: n for a, n in c.items() if a not in seen}
            weight = sum(left.values()) + len(left)
            if not weight:
                continue
            if y in left:
                return total + math.log10(left[y] / weight)
            total += math.log10(len(left) / weight)
            seen |= set(c)
        return total - math.log10(255 - len(seen))

    def score(t):
        s = b"\xff" * 4 + t + b"\xfe"
        return sum(symbol(s[k - 4 : k], s[k]) for k in range(4, len(s)))

    return counts, score, symbol


def held_two(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_ppm_against_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 5] + [(20 + i, f"Ab{i % 5}r ab{i % 3}c a{i}") for i in range(60)]
    texts = [(i, (t or "").encode().lower()) for i, t in rows]
    counts, score, symbol = brute_ppm(texts, held_two)
    n, v = sum(counts.values()), len(counts)
    for block in (1 << 30, 200):
        got = lm_scoring.score_documents(documents(spark, [(i, t, "s") for i, t in rows]), lm_scoring.fold(7) == 2, block).collect()
        assert len(got) == len(rows) and {r.held_out for r in got} == {True, False}
        by_id = dict(texts)
        for r in got:
            t = by_id[r.doc_id]
            tokens = [*t.split(), b""]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held_two(r.doc_id), len(tokens), n)
            assert r.n_known == sum(counts[w] > 0 for w in tokens)
            assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
            assert r.score == pytest.approx(score(t))
    for ctx in (b"\xff\xff\xff\xff", b"\xff\xffab", b"zzzz", b"ab1r"):
        assert sum(10 ** symbol(ctx, y) for y in range(255)) == pytest.approx(1)


def test_token_counts_as_the_library(odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = odd.collect()
    for entries in (50_000, 3):
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, BPE, entries=entries).collect())
        want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in rows]
        assert got == collections.Counter((*w, w[2] > 512) for w in want)


def test_pre_tokens_agree_on_every_safe_character():
    t = token_counts._tokenizer(BPE)
    safe = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not token_counts._OTHER.search(chr(c))]
    assert len(safe) > 30_000
    for c in safe:
        x = f"a{c}b 1{c}2  {c}! {c}\n{c}x"
        assert token_counts._PRE.findall(x) == [x[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(x)]


def test_licence_places(spark, odd):
    got = {r.doc_id: r for r in license_scan.scanned(odd).collect()}
    assert (got[10].n_base, got[10].first_word, got[10].last_word, got[10].base_labels, got[10].score) == (2, 0, 2, "mit", 1.0)
    assert all((got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, 0, None, "", 0.0) for i in (1, 2, 3))
    assert license_scan.scanned(odd).count() == odd.count()
    rows = [
        (1, "x GNU General Public-License, version 3. Apache\nLicense apachelicense MIT  license", "s"),
        (2, "Licensed under CC BY-NC 4.0.", "s"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "s"),
        (4, "the license of mit and public general license", "s"),
    ]
    got = {r.doc_id: r for r in license_scan.scanned(documents(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 2, 10, "apache,gpl,mit")
    assert (got[2].n_base, got[2].base_labels, got[2].labels) == (0, "", "cc-by-nc")
    assert (got[3].base_labels, got[3].labels) == ("", "mit")
    assert (got[4].labels, got[4].score) == ("", 0.0)


def test_licence_rows_of_one_id_and_of_none(spark):
    said = "Released under the MIT License"
    rows = [(None, said, "s"), (None, "nothing", "s"), (5, said, "s"), (5, "apache license, apache license", "s"), (5, said, "s")]
    rows += [(None, f"{said} no {i}", "s") for i in range(200)]
    got = collections.Counter((r.doc_id, r.n_base, r.base_labels) for r in license_scan.scanned(documents(spark, rows)).collect())
    assert got == {(None, 1, "mit"): 201, (None, 0, ""): 1, (5, 1, "mit"): 2, (5, 2, "apache"): 1}


def brute_components(texts, n, percent):
    """component of each id: texts is {id: text}."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    texts = {r.doc_id: r.text for r in odd.collect()}
    for g in range(3):
        for k in range(25):  # copies of one text with more and more words changed
            w = [x if rng.random() > 0.003 * k else f"q{rng.integers(10**6)}" for x in base]
            texts[100 + 50 * g + k] = " ".join(f"{g}{x}" for x in w)
    rows = [(i, t, "s") for i, t in texts.items()] + [(6, texts[6], "s")]
    for n, percent in ((3, 85), (5, 80)):
        want, sizes = brute_components(texts, n, percent)
        assert sum(i != c for i, c in want.items()) > 20
        for block in (1_000, 7):
            got = minhash_dedup.near_duplicates(documents(spark, rows), n, percent, block=block).collect()
            assert len(got) == len(rows)
            assert all((r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id) for r in got)


def test_one_of_repeated_rows_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a")] * 3 + [(2, text, "a")] * 2 + [(3, "another text", "a"), (4, None, "a"), (4, None, "a"), (None, "no id", "a"), (None, "no id", "a")]
    got = minhash_dedup.drop_near_duplicates(documents(spark, rows).withColumn("rep", F.lit(1)))
    assert collections.Counter(r.doc_id for r in got.collect()) == {1: 1, 3: 1, 4: 1, None: 2}


def test_near_duplicates_without_ids(spark):
    text = "one two three four five six seven eight"
    docs = documents(spark, [(None, text, "s"), (None, text, "s"), (5, text, "s"), (6, text, "s")])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [(0, 4, None, True), (0, 4, None, True), (5, 4, 5, True), (6, 4, 5, False)]
    kept = minhash_dedup.drop_near_duplicates(docs).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 5]


def test_candidates_hold_pairs_at_the_threshold():
    """Recall of the tensored tables on pairs of sets at a similarity of 0.8."""
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(400):
        common, a, b = np.split(rng.integers(0, 2**63, 1000).astype(np.uint64), [800, 900])
        sets += [np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))]
    keys = minhash_dedup._half_keys(minhash_dedup._minima(sets, 128), 4)
    same = keys[:, 0::2] == keys[:, 1::2]
    assert (same[:16].any(0) & same[16:].any(0)).mean() >= 0.99


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"a b c d", b"", b" a  b\tc\nd ", b"a", b"a b", b"ab", b"a b c d e"]
    alone = [shingle_sets([t], 3)[0] for t in texts]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(alone, shingle_sets(texts, 3)))
    assert (alone[0] == alone[2]).all() and len({x.tobytes() for x in alone}) == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}


def iterated_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """The targets by dealing again what is cut, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        for s in over:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


@pytest.mark.parametrize("block", [64, 3])
def test_mixture(spark, odd, block):
    rng = np.random.default_rng(5)
    rows = [(100 + i, "w " * int(rng.integers(1, 60)), [None, "a", "B", "é", "zz"][i % 5]) for i in range(900)]
    rows += [(2_000 + i, "w", "hot") for i in range(700)] + [(3_000, "", "empty")]
    docs = documents(spark, rows)
    got = mixing.mixture(docs, block).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs, block).collect()))
    size = {i: len(t.split()) for i, t, _ in rows}
    of = collections.Counter()
    for i, _, s in rows:
        of[s] += size[i]
    want, taken = iterated_targets(dict(of)), collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == of[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in of)
    assert mixing.mixture(odd).count() == odd.count()
    copies = collections.Counter(r.doc_id for r in mixing.mix(docs, block=block).collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in got if r.copies and r.size})


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, f"n{i} " * 20, "a") for i in range(150)] + [(7, f"r{i} " * 20, "a") for i in range(150)] + [(100 + i, "w " * 20, "b") for i in range(600)]
    taken = mixing.mix(documents(spark, rows)).collect()
    got = collections.Counter(r.source for r in taken for _ in r.text.split())
    want = iterated_targets({"a": 6_000, "b": 12_000})
    assert all(abs(got[s] - want[s]) <= 60 for s in want)
    assert set(collections.Counter(r.text for r in taken if r.source == "a").values()) == {2} and len({r.text for r in taken}) == 301


def test_mixture_of_one_id(spark):
    rows = [(None if i % 3 else 7, "w " * 20, "a") for i in range(3_000)] + [(100 + i, "w " * 20, "b") for i in range(3_000)]
    got = mixing.mixture(documents(spark, rows)).collect()
    taken, want = collections.Counter(), iterated_targets({"a": 60_000, "b": 60_000})
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == 6_000 and all(abs(taken[s] - want[s]) <= 60 for s in want)


def test_scores_of_null_ids(spark):
    rows = [(None, "only here", "s"), (None, "twice", "s"), (1, "twice", "s")]
    got = lm_scoring.fold_scores(documents(spark, rows)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known) for r in got if r.doc_id is None and r.n_tokens == 3] == [(False, 3, 3)] and len(got) == 3


def test_pieces_as_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r.doc_id: r.text for r in odd.collect()}
    got = sentencepiece_codec.encoded(odd, PIECES).cache()
    for r in got.collect():
        assert r.ids == sp.encode(rows[r.doc_id] or "") and r.n_pieces == len(r.ids)
        assert r.restored == (r.doc_id != 8)  # it holds the blank's own character
    for r in sentencepiece_codec.decoded(got, PIECES).collect():
        assert r.text == sp.decode(sp.encode(rows[r.doc_id] or ""))
    m, rng, letters = sentencepiece_codec.model(PIECES), np.random.default_rng(2), list("ab the in▁  \n\té漢<s>01\x00😀IJ")
    for _ in range(1_500):
        t = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert m.encode(t) == sp.encode(t) and m.decode(m.encode(t)) == sp.decode(sp.encode(t))


def test_unigram_path_is_the_best_one():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "bb", "xab", "▁"]
    scores = [0.0, -2.0, -2.5, -3.1, -3.0, -5.4, -4.0, -1.0, -1.0]
    m = sentencepiece_codec.PieceModel(pieces, scores, [2] + [1] * 8, kind=sentencepiece_codec.UNIGRAM)

    def best(t):
        if not t:
            return 0.0
        ways = [best(t[len(p) :]) + s for p, s in zip(pieces[1:], scores[1:]) if t.startswith(p)]
        return max(ways + ([best(t[1:]) + m.lowest] if t[0] not in m.usable else []))

    rng = np.random.default_rng(4)
    for _ in range(200):
        t = "".join(rng.choice(list("abx▁"), rng.integers(0, 9)))
        got = sum(scores[p] if p >= 0 else m.lowest for _, _, p in m._path(t))
        assert got == pytest.approx(best(t))
