"""Runs of repeated words by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical) that is `least` words and two periods long
at least and that no neighbouring word extends. All texts of a slice are searched at once:

1. The dictionary names every factor (stretch) of 1, 2, 4, ... words: a factor's name is that of its two halves. Only
   factors that occur again in their document are named, so the dictionary shrinks to what repeats.
2. Successor occurrences of a factor of L words that stand within 2 L words of it fall into few arithmetic progressions,
   since occurrences that overlap much are all one period of the factor apart. From each occurrence the walk goes from one
   progression to the next, to the right over their first members and to the left over their last ones, and proposes the
   distances as periods.
3. A proposal is extended both ways, by factors of falling length; the stretch it fills is a run if it is long enough.
   Proposals that fill the same stretch are one run, of their smallest period.

No run is missed. Let s be its start, p its period, L <= p < 2 L, and u the factor at s, which stands at s + p too. If both
are in one progression, its step is p, as p is the smallest period. Else either s + p is the first of its progression, so
the walk from s comes there; or u also stands one step before s + p, and then the stretch with u's period around s ends
inside the run, so its image p words on ends there as well, and the walk to the left from its last u comes to the last u
of the first.

Words are compared through an exact dictionary of the slice, texts are never cut, and nothing is shuffled: memory follows
the slice, which holds one text at least.

Defined cases: a null or empty text has no words and no runs; repeated rows are reported row by row; a null id counts as an
empty decimal; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_slices, session_of

LEAST = 12
SLICE_BYTES = 1 << 20


@dataclass(frozen=True)
class Runs:
    """Runs in order of document, start and period; starts count from the document's first word."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _names(keys: np.ndarray) -> np.ndarray:
    """A number for each value that occurs more than once, -1 for the others."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(count[name] > 1, name, -1)


def basic_factors(words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The names of the factors of 1, 2, 4, ... words at every place, -1 where a factor leaves its document or does not
    occur again in it. `words` are numbers, documents one after the other."""
    n = len(words)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    levels = [_names(doc * (int(words.max()) + 1) + words)] if n else []
    size = 1
    while levels and (levels[-1] >= 0).any():
        half, name = levels[-1], np.full(n, -1, np.int64)
        at = np.flatnonzero(half >= 0)
        at = at[at + 2 * size <= ends[at]]
        at = at[half[at + size] >= 0]
        name[at] = _names(half[at] * n + half[at + size])
        levels.append(name)
        size *= 2
    return levels[:-1]


def _walk(place: np.ndarray, name: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the first occurrences of the progressions that follow each occurrence within `reach`. Occurrences are
    sorted by name and place; places may also fall, for the walk to the left."""
    n = len(place)
    gap = np.abs(np.diff(place))
    gap = np.append(np.where(name[1:] == name[:-1], gap, np.iinfo(np.int64).max), np.iinfo(np.int64).max)
    turns = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    turns = np.append(turns, n)
    last = turns[np.searchsorted(turns, np.arange(n), side="right")]  # of the progression that an occurrence starts
    origin = cursor = np.flatnonzero(gap <= reach)
    found = []
    while len(origin):
        found.append((place[origin], place[cursor + 1]))
        cursor = last[cursor]
        going = cursor < n
        origin, cursor = origin[going], cursor[going]
        going = gap[cursor] <= reach
        origin, cursor = origin[going], cursor[going]
        near = np.abs(place[cursor + 1] - place[origin]) <= reach
        origin, cursor = origin[near], cursor[near]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _thinned(key: np.ndarray) -> np.ndarray:
    """The distinct keys that do not follow the next smaller number."""
    key = np.unique(key)
    return key[np.append(True, np.diff(key) != 1)] if len(key) else key


def _proposals(levels: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): proposals of one period at neighbouring places are one, and are thinned level by level."""
    keys = [np.zeros(0, np.int64)]
    for k, name in enumerate(levels):
        at = np.flatnonzero(name >= 0)
        at = at[np.argsort(name[at], kind="stable")]
        for order in (at, at[::-1]):
            here, there = _walk(order, name[order], 2 << k)
            keys.append(_thinned(np.abs(there - here) * n + np.minimum(here, there)))
    key = _thinned(np.concatenate(keys))
    return key % max(n, 1), key // max(n, 1)


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, way: int) -> np.ndarray:
    """How many words from places a and b on agree, to the right (way 1) or before them, to the left (way -1). Places
    stay inside [low, high) of their document."""
    total = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size, name = 1 << k, levels[k]
        x = a + total if way > 0 else a - total - size
        y = b + total if way > 0 else b - total - size
        fits = (x >= low) & (y + size <= high)
        x, y = np.where(fits, x, 0), np.where(fits, y, 0)
        total += np.where(fits & (name[x] >= 0) & (name[x] == name[y]), size, 0)
    return total


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of all documents; `words` are their words as numbers, one document after the other."""
    n = len(words)
    levels = basic_factors(words, lengths)
    place, period = _proposals(levels, n)
    tops = np.cumsum(lengths)
    doc = np.searchsorted(tops, place, side="right")
    low, high = tops[doc] - lengths[doc], tops[doc]
    after = _common(levels, place, place + period, low, high, 1)
    before = _common(levels, place, place + period, low, high, -1)
    start, length = place - before, before + period + after
    long = length >= np.maximum(least, 2 * period)
    doc, start, length, period = doc[long], (start - low)[long], length[long], period[long]
    order = np.lexsort((period, length, start, doc))
    doc, start, length, period = (x[order] for x in (doc, start, length, period))
    if len(doc):
        new = np.append(True, (np.diff(doc) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0))
        doc, start, length, period = (x[new] for x in (doc, start, length, period))
    order = np.lexsort((period, start, doc))
    return Runs(*(x[order] for x in (doc, start, length, period)))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, equal for equal words, and how many each text has."""
    flat = pa.array([w for t in texts for w in t], pa.binary())
    return flat.dictionary_encode().indices.to_numpy().astype(np.int64), np.array([len(t) for t in texts], np.int64)


def repeated(doc_words: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words of a document stand in a run after its first period."""
    edge = np.zeros(doc_words + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the contract: in a tenth of the documents, by the checksum of the id, the words from some place on
    are the first of them over and over."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * (-(-(n - a) // p)))[: n - a]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, starts array<long>, lengths array<long>, periods array<long>, collapsed string"
)


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite=None) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (ties: smallest start, then period; null without a run), all runs,
    the text with only the first period of each run (words joined by a blank), and digests of both. `rewrite`, if given,
    turns (doc_id, words) into the words to search."""
    session_of(docs)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for b in in_slices(batches, "text", SLICE_BYTES):
            ids = b.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in b.column("text").to_pylist()]
            if rewrite:
                texts = [rewrite(i, t) for i, t in zip(ids, texts)]
            r = find_runs(*numbered(texts), least)
            cuts = np.searchsorted(r.doc, np.arange(len(texts) + 1))
            rows = []
            for k, (i, t) in enumerate(zip(ids, texts)):
                s, m, p = (x[cuts[k] : cuts[k + 1]] for x in (r.start, r.length, r.period))
                kept = t
                if len(s):
                    gone = repeated(len(t), s, m, p)
                    kept = [w for w, g in zip(t, gone.tolist()) if not g]
                top = int(np.lexsort((p, s, -m))[0]) if len(s) else None
                best = (None,) * 4 if top is None else (int(s[top]), int(m[top]), int(p[top]), 1000 * int(m[top]) // int(p[top]))
                told = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), m.tolist(), p.tolist()))
                text = b" ".join(kept)
                digests = (hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest())
                rows.append((i, len(s), *best, *digests, s.tolist(), m.tolist(), p.tolist(), text.decode("utf-8", "replace")))
            long, list_ = pa.int64(), pa.list_(pa.int64())
            types = [long] * 6 + [pa.string()] * 2 + [list_] * 3 + [pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def looped_runs(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    return periodic_runs(docs, LEAST, looped).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
