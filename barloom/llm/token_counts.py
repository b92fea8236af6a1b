"""Token counts by a two-tier table look-up, without shuffling pre-tokens.

Tier one is a compact table (pre-token, number of tokens) of frequent pre-tokens, made from the vocabulary and from a
bounded sample of documents and broadcast; its size is bounded by `table_entries`. Tier two is a bounded cache in every
Python worker, filled by the tokenizer itself. What is in either tier changes the speed only, never a count: every
pre-token's length is what the library gives for it.

Texts that hold a special string, or characters outside the blocks for which the pattern's classes are known to be the
same in both regular-expression libraries, are encoded whole by the library.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted row by row; further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_slices, session_of, texts_of

# The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Blocks of long standing, in which letters, numbers and blanks do not depend on the Unicode version.
_OTHER = regex.compile(r"[^\x00-˿Α-ώЀ-ҁ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
_PRE = regex.compile(PATTERN)

CACHE_ENTRIES = 1_000_000
TABLE_ENTRIES = 50_000
SAMPLE_DOCS = 512
SAMPLE_CHARS = 4_000_000


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _specials(path: str):
    """A pattern of the added tokens' strings, which the library takes out of a text first."""
    with open(path, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    return regex.compile("|".join(map(regex.escape, added))) if added else None


@cache
def _alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself where Latin-1 prints it, else the
    next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def piece_lengths(path: str, pieces: list[str]) -> list[int]:
    """Number of tokens of each pre-token: the library's model alone, on the bytes' stand-ins."""
    merge, stand_in = _tokenizer(path).model.tokenize, _alphabet()
    return [len(merge(p.encode().decode("latin-1").translate(stand_in))) for p in pieces]


def lengths(path: str, pieces: list[str]) -> list[int]:
    """Number of tokens of each text, by the library."""
    return [len(e.ids) for e in _tokenizer(path).encode_batch(pieces, add_special_tokens=False)]


def frequent_table(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> tuple[str, bytes]:
    """The frequent pre-tokens, joined by NUL, and one byte each for their number of tokens.

    Counted over at most SAMPLE_DOCS documents that a hash of the id picks, SAMPLE_CHARS characters in all; pre-tokens
    with NUL or of over 255 tokens stay out. At most `entries` rows.
    """
    short = docs.where(F.length("text") <= SAMPLE_CHARS // SAMPLE_DOCS)
    h = F.xxhash64("doc_id")
    first = short.groupBy(F.pmod(h, F.lit(SAMPLE_DOCS)).alias("slot")).agg(F.min_by("doc_id", h).alias("id"))
    ids = [r.id for r in first.select("id").collect()]  # SAMPLE_DOCS at most
    picked = short.where(F.col("doc_id").isin(ids)).select("text").limit(SAMPLE_DOCS).collect() if ids else []
    seen = Counter(p for r in picked if not _OTHER.search(r.text) for p in _PRE.findall(r.text) if "\0" not in p)
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    kept = [(w, n) for w, n in zip(words, piece_lengths(path, words)) if n <= 255]
    return "\0".join(w for w, _ in kept), bytes(n for _, n in kept)


_CACHES: dict[tuple, dict[str, int]] = {}


def _counter(path: str, table: tuple[str, bytes]):
    """A function from texts to token counts; its cache lives as long as the Python worker."""
    key = (path, len(table[1]), hash(table[0]))
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = dict(zip(table[0].split("\0"), table[1])) if table[1] else {}
    known, special, fixed = _CACHES[key], _specials(path), len(table[1])

    def count(text: str) -> int:
        if not text:
            return 0
        if _OTHER.search(text) or (special and special.search(text)):
            return lengths(path, [text])[0]
        pre = _PRE.findall(text)
        found = list(map(known.get, pre))
        if None in found:
            new = list({p for p, n in zip(pre, found) if n is None})
            got = dict(zip(new, piece_lengths(path, new)))
            if len(known) + len(new) > fixed + CACHE_ENTRIES:
                known.clear()
                known.update(zip(table[0].split("\0"), table[1]) if table[1] else ())
            if len(new) <= CACHE_ENTRIES:
                known.update(got)
            return sum(got[p] if n is None else n for p, n in zip(pre, found))
        return sum(found)

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 512, entries: int = TABLE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    shared = session_of(docs).sparkContext.broadcast(frequent_table(docs, path, entries))

    def run(batches):
        count = _counter(path, shared.value)
        for b in in_slices(batches, "text"):
            n = pa.array([count(t) for t in texts_of(b.column("text"))], pa.int64())
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
