"""Text quality by nearest-neighbour voting in a latent semantic space.

A text's terms are short grams of its shape: bytes mapped to classes (small letter, capital, digit, blank, new line, each
mark for itself), runs of one class of letters or digits as one, so that quality and not language is what texts have in
common. One term more counts the words that repeat the two before them, which the shape of a text does not show. Hashed into
`terms` - 1 buckets, which that term follows, damped by the logarithm and weighted by rarity, they are projected on the leading
singular vectors of a labelled sample. The sample's vectors and labels are broadcast, and every document is compared with
all of them by blocked cosine products; the `neighbours` nearest vote with the fourth power of their similarity, which
tells near neighbours from far ones where all are similar.

The model is fitted on at most `sample` labelled training rows, those with the smallest hashes of their ids, one text for
each id and label. Their term counts, not their texts, come to the driver: sample x terms numbers at most, whatever the
length of a text. The model is bounded by sample x rank + terms x rank numbers. Nothing else is drawn from the corpus, and
every document is scored whole.

Defined cases: a null text is empty; an empty text has no direction and gets the share of label 1 in the sample, as does
every text where no neighbour is similar at all; without labelled rows every score is 0.5; ids labelled twice count twice, and
of several texts of one id the one with the smallest terms is learnt; a null id is not held out;
further columns of `documents` are ignored by `scored` and kept by `keep_good`; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fold, in_slices, session_of

SAMPLE = 4_000
TERMS = 4_096
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
GRAM = 4
SLICE_BYTES = 1 << 19
_ROWS = 512


def _classes() -> np.ndarray:
    """The class of each byte: marks are their own, letters (with all bytes above ASCII), capitals, digits and blanks
    share one each."""
    c = np.arange(256, dtype=np.int64)
    c[97:123] = c[128:256] = 97
    c[65:91] = 65
    c[48:58] = 48
    c[[9, 11, 12, 13, 32]] = 32
    return c


_CLASS = _classes()
_RUNS = np.isin(_CLASS, [97, 65, 48])


def repeats(text: bytes) -> int:
    """Words that are the same as each of the two before them. Two in a row also happen in good texts."""
    words = text.split()
    same = list(map(eq, words, words[1:]))
    return sum(map(and_, same, same[1:]))


def term_counts(texts: list[bytes], terms: int = TERMS) -> np.ndarray:
    """Hashed shape grams of each text and, as the last term, its repeated words, (texts, terms)."""
    joined = np.frombuffer(b"".join(t + b"\0" * GRAM for t in texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), [len(t) + GRAM for t in texts])
    shape = _CLASS[joined]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUNS[joined[1:]]
    shape, of = shape[keep], of[keep]
    code = np.zeros(max(0, len(shape) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        code = code * np.uint64(257) + shape[i : i + len(code)].astype(np.uint64)
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
    whole = (of[: len(code)] == of[GRAM - 1 :]) & (shape[: len(code)] != 0)
    at = of[: len(code)][whole] * terms + (code[whole].astype(np.int64) % (terms - 1))
    counts = np.bincount(at, minlength=len(texts) * terms).reshape(len(texts), terms).astype(np.float32)
    counts[:, -1] = [repeats(t) for t in texts]
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@dataclass(frozen=True)
class Model:
    rarity: np.ndarray  # (terms)
    axes: np.ndarray  # (terms, rank)
    vectors: np.ndarray  # (sample, rank), unit rows
    labels: np.ndarray  # (sample)
    neighbours: int

    def latent(self, texts: list[bytes]) -> np.ndarray:
        weighted = _unit(np.log1p(term_counts(texts, len(self.rarity))) * self.rarity)
        return _unit(weighted @ self.axes)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the neighbours' votes."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return out
        for lo in range(0, len(texts), _ROWS):
            near = self.latent(texts[lo : lo + _ROWS]) @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** 4
            total = vote.sum(1)
            some = total > 0
            out[lo : lo + _ROWS][some] = np.clip((vote * self.labels[top]).sum(1)[some] / total[some], 0, 1)
        return out


def _leading_axes(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration with a few spare directions."""
    y = np.random.default_rng(0).normal(size=(x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        y, _ = np.linalg.qr(x.T @ (x @ y))
    _, _, turn = np.linalg.svd(x @ y, full_matrices=False)
    return (y @ turn.T)[:, :rank].astype(np.float32)


def fit_counts(counts: np.ndarray, labels: list[int], rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """A model of labelled rows by their term counts, (rows, terms)."""
    n, terms = counts.shape
    if not n:
        return Model(np.zeros(terms, np.float32), np.zeros((terms, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    rarity = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    weighted = _unit(np.log1p(counts) * rarity)
    axes = _leading_axes(weighted, min(rank, terms))
    return Model(rarity, axes, _unit(weighted @ axes), np.array(labels, float), neighbours)


def fit_texts(texts: list[bytes], labels: list[int], terms: int = TERMS, **options) -> Model:
    parts = [term_counts(texts[lo : lo + _ROWS], terms) for lo in range(0, len(texts), _ROWS)]
    return fit_counts(np.concatenate([np.zeros((0, terms), np.float32), *parts]), labels, **options)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, terms: int = TERMS, **options) -> Model:
    """A model of the labelled training rows. `labels` has doc_id and quality."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out).select("doc_id", F.col("quality").cast("int").alias("label"))
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    def counted(batches):
        for b in in_slices(batches, "text", SLICE_BYTES):
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                c = term_counts([t or b"" for t in part.column("text").to_pylist()], terms)
                term = pa.array([np.flatnonzero(r) for r in c], pa.list_(pa.int32()))
                count = pa.array([r[r > 0] for r in c], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), term, count], ["doc_id", "label", "term", "count"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(first), "doc_id")
    found = texts.mapInArrow(counted, "doc_id long, label int, term array<int>, count array<float>")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct("term", "count")).alias("c"))
    times = first.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(one.join(F.broadcast(times), ["doc_id", "label"]).collect(), key=lambda r: (r.doc_id, r.label))  # `sample` rows
    rows = [r for r in rows for _ in range(r.n)]
    counts = np.zeros((len(rows), terms), np.float32)
    for i, r in enumerate(rows):
        counts[i, r.c.term] = r.c["count"]
    return fit_counts(counts, [int(r.label > 0) for r in rows], **options)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; one fold of the ids is never learnt from."""
    spark = session_of(docs)
    held_out = F.coalesce(fold(folds) == held, F.lit(False))
    shared = spark.sparkContext.broadcast(fit(docs, labels, held_out, **options))

    def run(batches):
        for b in in_slices(batches, "text", SLICE_BYTES):
            s = shared.value.score([t or b"" for t in b.column("text").to_pylist()])
            flag = pa.array((s >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), flag], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """`docs` without the rows that score below the threshold, all columns kept. Scored in place, row by row."""
    spark = session_of(docs)
    shared = spark.sparkContext.broadcast(fit(docs, labels, fold(folds) == held, **options))

    def run(batches):
        for b in in_slices(batches, "text", SLICE_BYTES):
            good = shared.value.score([(t or "").encode() for t in b.column("text").to_pylist()]) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
