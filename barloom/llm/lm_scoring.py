"""Document scores under a pretrained PPM model: a byte-context trie with escape estimation (method C) and symbol
exclusion, learnt from the training documents only. A word unigram baseline is scored beside it.

The trie has contexts of up to four bytes of the text in lower case (A-Z only), with four start marks before it and an end
mark behind it, so it is fixed by the counts of five-byte grams. A symbol that a context has not seen escapes to the
context's suffix with the weight of the number of distinct symbols seen there, and what the longer context has seen is
excluded below it; at the end all of the alphabet that is left is equally likely.

Neither the trie nor the word counts are broadcast or held in one task, since both grow with the corpus:

1. Documents are dealt into blocks of about `block_bytes`; a block's distinct grams and words are counted in its task.
2. Counts are summed over blocks. Each gram's log-probability follows from the grams whose context ends in the same two
   bytes (a bounded part of the trie) and from the 65,536 counts of byte pairs.
3. Each block gets back the values of the grams and words that it has, and scores its texts from them.

Defined cases: a null text is empty; an empty text has one token, the end, and the probability of the end mark at the start;
repeated rows are scored row by row; without training documents the baseline is 0 and every symbol equally likely; further
columns are ignored; an empty table gives an empty result; a row with a null id is in no fold, so it is learnt from.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import bytes_of, fold, session_of
from barloom.session import stage

ORDER = 4
START, END = 0xFF, 0xFE  # neither occurs in UTF-8
ALPHABET = 255  # all bytes but the start mark
BLOCK_BYTES = 32 << 20
SLICE_BYTES = 4 << 20
PACK_GRAMS = 400_000


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram (context and symbol) at each position of all texts, and where each text starts among them."""
    raw = np.frombuffer(b"".join(b"\xff\xff\xff\xff" + t + b"\xfe" for t in texts), np.uint8)
    code = np.zeros(len(raw) - ORDER, np.int64)
    for i in range(ORDER + 1):
        code = (code << 8) | raw[i : i + len(code)]
    sizes = np.array([len(t) + 1 for t in texts])
    return code[raw[ORDER:] != START], np.cumsum(sizes) - sizes


def _slices(texts: list[bytes]):
    """Runs (from, to) of texts of about SLICE_BYTES."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def _count_block(t: pa.Table) -> pa.Table:
    """Distinct grams and words (the end is the empty word) of a block with their number in its training documents."""
    texts, held = bytes_of(t.column("text")), t.column("held_out").to_pylist()
    words, codes, counts = Counter(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for out in (False, True):
        part = [x for x, h in zip(texts, held) if h == out]
        for lo, hi in _slices(part):
            code, n = np.unique(_grams(part[lo:hi])[0], return_counts=True)
            codes.append(code)
            counts.append(n * (not out))
            if len(codes) > 4:
                code, n = _merged(codes, counts)
                codes, counts = [code], [n]
        for x in part:
            if out:
                words.update(dict.fromkeys(x.split(), 0))
            else:
                words.update(x.split())
        words[b""] += 0 if out else len(part)
    code, n = _merged(codes, counts)
    k, m = len(code), len(words)
    return pa.table(
        {
            "block": pa.array(np.full(k + m, t.column("block")[0].as_py(), np.int32)),
            "gram": pa.concat_arrays([pa.array(code), pa.nulls(m, pa.int64())]),
            "word": pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array(list(words), pa.binary())]),
            "n": pa.concat_arrays([pa.array(n), pa.array(list(words.values()), pa.int64())]),
        }
    )


def _level(grams: np.ndarray, counts: np.ndarray, k: int):
    """Cells (context and symbol) of order k with counts; contexts with the sum and the number of their cells."""
    cell, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
    c = np.bincount(at, counts, len(cell))
    ctx, of = np.unique(cell >> 8, return_inverse=True)
    return cell, c, ctx, of, np.bincount(of, c, len(ctx)), np.bincount(of, minlength=len(ctx)).astype(float)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at `wanted`, 0 where it is not among the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted))
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0.0)


def gram_scores(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each gram after the bytes before it. `grams` holds all grams of the contexts
    concerned; `pairs` is the 256 x 256 table of counts of a byte after a byte."""
    seen = counts > 0
    single = pairs.sum(0).astype(float)
    used = (pairs > 0).astype(float)
    levels = {k: _level(grams[seen], counts[seen], k) for k in range(ORDER, 1, -1)}
    score, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    gone = gone_kinds = np.zeros(len(grams))
    byte, before = grams & 0xFF, (grams >> 8) & 0xFF
    for k in range(ORDER, -1, -1):
        if k > 1:
            cell, c, ctx, of, total, kinds = levels[k]
            below = _find(levels[k - 1][0], levels[k - 1][1], cell & ((1 << 8 * k) - 1)) if k > 2 else pairs[(cell >> 8) & 0xFF, cell & 0xFF]
            hidden = np.bincount(of, below, len(ctx))
            mine = (grams >> 8) & ((1 << 8 * k) - 1)
            here, t, d, h = _find(cell, c, grams & ((1 << 8 * (k + 1)) - 1)), *(_find(ctx, x, mine) for x in (total, kinds, hidden))
        elif k == 1:
            here, t, d, h = pairs[before, byte], pairs.sum(1)[before], used.sum(1)[before], (used @ single)[before]
        else:
            here, t, d, h = single[byte], single.sum(), float((single > 0).sum()), 0.0
        left, kinds_left = t - gone, d - gone_kinds
        weight = left + kinds_left
        found, escapes = open_ & (here > 0), open_ & (here == 0) & (weight > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            score += np.where(found, np.log10(here / weight), 0.0) + np.where(escapes, np.log10(kinds_left / weight), 0.0)
        open_ &= ~found
        gone, gone_kinds = h, d
    return score - open_ * np.log10(max(ALPHABET - float((single > 0).sum()), 1.0))


def score_documents(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = session_of(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = docs.select(
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
    )
    counted = stage(dealt.groupBy("block").applyInArrow(_count_block, "block int, gram long, word binary, n long"))
    grams, words = counted.where("gram is not null"), counted.where("word is not null")

    word_counts = stage(words.groupBy("word").agg(F.sum("n").cast("double").alias("x")))
    n, v = word_counts.agg(F.sum("x"), F.count_if(F.col("x") > 0)).first()
    n, v = int(n or 0), int(v or 0)

    gram_counts = stage(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    low = gram_counts.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    table = np.zeros(1 << 16, np.int64)
    for r in low:
        table[r.pair] = r.n
    pairs = spark.sparkContext.broadcast(table.reshape(256, 256))
    packs = max(8, -(-gram_counts.count() // PACK_GRAMS))

    def scored(t: pa.Table) -> pa.Table:
        g, c = t.column("gram").to_numpy(), t.column("n").to_numpy()
        return pa.table({"gram": pa.array(g), "x": pa.array(gram_scores(g, c, pairs.value))})

    ends_alike = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    gram_values = (
        gram_counts.withColumn("pack", F.pmod(F.xxhash64(ends_alike), F.lit(packs)).cast("int"))
        .groupBy("pack")
        .applyInArrow(scored, "gram long, x double")
    )
    asked = (
        grams.select("block", "gram").join(gram_values, "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), "x")
    ).unionByName(words.select("block", "word").join(word_counts, "word").select("block", F.lit(None).cast("long").alias("gram"), "word", "x"))

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        is_gram = values.column("gram").is_valid()
        own = values.filter(is_gram)
        code, x = own.column("gram").to_numpy(), own.column("x").to_numpy()
        order = np.argsort(code)
        code, x = code[order], x[order]
        rest = values.filter(values.column("word").is_valid())
        count = dict(zip(rest.column("word").to_pylist(), rest.column("x").to_pylist()))
        raw = bytes_of(texts.column("text"))
        ppm, tokens, known, base = [], [], [], []
        for lo, hi in _slices(raw):
            at, starts = _grams(raw[lo:hi])
            ppm.append(np.add.reduceat(x[np.searchsorted(code, at)], starts))
        for t in raw:
            found = t.split()
            found.append(b"")
            c = np.fromiter(map(count.__getitem__, found), float, len(found))
            tokens.append(len(found))
            known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 1) / (n + v + 1)).sum()))
        ids = texts.column("doc_id")
        return pa.table(
            {
                "doc_id": ids,
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(np.concatenate(ppm) if ppm else [], pa.float64()),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, schema)


def fold_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores with one fold of the ids held out."""
    return score_documents(docs, fold(folds) == held)
