"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

One pass over a text: at each position the automaton's output links give the pieces that end there, longest first, and each
is tried on the best path to the position where it starts. For a unigram model the sum of scores decides (Viterbi). For a BPE
model sums of its scores do not give the merges' result; there a piece is admitted only if it and the last piece on the path
stand next to each other in the merges' own encoding of the two, which holds for one path only and gives what the
merges give. Characters that no piece covers become bytes where the model has them.

Blanks only begin pieces, so a text falls into units (blanks and what follows up to the next blank) that are encoded
independently; a bounded cache in each Python worker keeps encoded units. Whether a unit was in the cache changes the
speed only. Models whose pieces span units are encoded as a whole.

Defined cases: a null or empty text has no pieces and is restored as empty; repeated rows are encoded row by row; further
columns are ignored; an empty table gives an empty result. A text that itself holds U+2581 comes back with blanks for it.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import in_slices, session_of, texts_of

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Field numbers and codes of the model's format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0

# Units in each of the two generations.
CACHE_UNITS = 250_000
CACHE_PAIRS = 400_000
SLICE_BYTES = 4 << 20


def _fields(data: bytes):
    """(field number, value) of a protocol buffer message: numbers as int, 32-bit values and texts as bytes."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind)
            size = number() if size is None else size
            yield tag >> 3, data[i : i + size]
            i += size


class PieceModel:
    """Pieces, scores and types by id, the kind of model, and how it prepares a text."""

    def __init__(self, pieces, scores, types, kind=BPE, dummy_prefix=True, prepare=None):
        if USER_DEFINED in types:
            raise ValueError("models with user-defined pieces are not supported")
        self.pieces, self.scores, self.types, self.kind = pieces, scores, types, kind
        self.dummy_prefix, self.prepare = dummy_prefix, prepare
        self.usable = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t == NORMAL and p}
        self.unknown = types.index(UNKNOWN) if UNKNOWN in types else -1
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(pieces, types)) if t == BYTE}
        self.lowest = min((scores[i] for i in self.usable.values()), default=0.0) - UNKNOWN_PENALTY
        self.by_unit = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.usable)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.usable.items():
            self.automaton.add_word(p, (i, len(p)))
        if self.usable:
            self.automaton.make_automaton()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._whole: dict[int, bool] = {}
        self._ordered: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._sizes = [len(p) for p in pieces]
        for i in self.usable.values() if kind == BPE else ():
            self._is_whole(i)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        blank = SPACE.encode()
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == BYTE else p.encode().replace(blank, b" ") if t == NORMAL else b" \xe2\x81\x87 " if t == UNKNOWN else b""
            for p, t in zip(pieces, types)
        ]

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, types, kind = [], [], [], UNIGRAM
        name, charsmap, prefix, squeeze = b"", b"", 1, 1
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                types.append(own.get(3, NORMAL))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                name, charsmap, prefix, squeeze = own.get(1, b""), own.get(2, b""), own.get(3, 1), own.get(4, 1)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have piece lattices")
        prepare = None
        if name != b"identity" or charsmap or squeeze:
            import sentencepiece

            prepare = sentencepiece.SentencePieceProcessor(model_file=path).normalize
        return cls(pieces, scores, types, kind, bool(prefix), prepare)

    def normal(self, text: str) -> str:
        """The text as the pieces spell it."""
        if self.prepare is not None:
            return self.prepare(text)
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def merges(self, text: str) -> list[str]:
        """The merges' encoding of a short text: the best-scored neighbours first, the leftmost of equals."""
        return self._merged(text)[0]

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The same, and the last two parts that were merged."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = self.usable.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or self.scores[j] > best):
                    best, at = self.scores[j], i
            if best is None:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = ["".join(last)]

    def _is_whole(self, i: int) -> bool:
        """Whether the merges make the piece out of its own text."""
        found = self._whole.get(i)
        if found is None:
            parts, last = self._merged(self.pieces[i])
            found = self._whole[i] = len(parts) == 1
            ids = tuple(self.usable.get(p, -1) for p in last) if found and last else None
            self._halves[i] = ids
            # Where parts were made before what they are in, by score, the order of merges is that of their scores.
            self._ordered[i] = found and (ids is None or min(ids) >= 0 and all(self._is_before(h, i) for h in ids))
        return found

    def _is_before(self, part: int, whole: int) -> bool:
        return self._is_whole(part) and self._ordered[part] and (self._halves[part] is None or self.scores[part] > self.scores[whole])

    def _are_neighbours(self, i: int, j: int) -> bool:
        """Whether the merges leave pieces i and j as they are when they stand next to each other.

        Followed back from the end: the merge that was made last on either side of the border is undone, and had a merge
        across the border been better than it, that would have been made instead.
        """
        if not self._is_whole(j):
            return False
        if not (self._ordered[i] and self._ordered[j]):
            a, b = self.pieces[i], self.pieces[j]
            return self.merges(a + b) == [a, b]
        pieces, scores, halves = self.pieces, self.scores, self._halves
        if pieces[i] + pieces[j] in self.usable:
            return False
        while True:
            left, right = halves[i], halves[j]
            if left is None and right is None:
                return True
            if right is None or (left is not None and scores[i] < scores[j]):
                made, i, first = scores[i], left[1], False
            else:
                made, j, first = scores[j], right[0], True  # a merge across the border is to the left of it
            across = self.usable.get(pieces[i] + pieces[j])
            if across is not None and (scores[across] > made or (first and scores[across] == made)):
                return False

    def _merge_path(self, text: str) -> list[int]:
        """At each position the last piece of the merges' encoding up to there; -1 after a character without a piece."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = -1
        pairs, wide, whole = self._pairs, len(self.pieces), self._whole
        for end, (i, size) in self.automaton.iter(text) if self.usable else ():
            if last[end + 1] is not None:
                continue
            before = last[end + 1 - size]
            if before is None:  # all pieces that end there have been tried
                before = last[end + 1 - size] = -1
            if before == -1:
                fits = whole[i]
            else:
                key = before * wide + i
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= CACHE_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self._are_neighbours(before, i)
            if fits:
                last[end + 1] = i
        return [-1 if p is None else p for p in last] if None in last else last

    def _score_path(self, text: str) -> list[int]:
        """At each position the last piece of the path of the largest sum of scores; -1 as above."""
        n = len(text)
        last, best = [-1] * (n + 1), [0.0] + [-np.inf] * n
        reached = 0

        def close(upto: int) -> None:
            nonlocal reached
            for k in range(reached + 1, upto + 1):
                score = best[k - 1] + self.lowest
                if score > best[k] and text[k - 1] not in self.usable:
                    last[k], best[k] = -1, score
            reached = upto

        for end, (i, size) in self.automaton.iter(text) if self.usable else ():
            close(end)
            score = best[end + 1 - size] + self.scores[i]
            if score > best[end + 1]:
                last[end + 1], best[end + 1] = i, score
        close(n)
        return last

    def _path(self, text: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) along the best path; piece -1 is a character that no piece covers."""
        last = self._merge_path(text) if self.kind == BPE else self._score_path(text)
        out, k = [], len(text)
        while k:
            p = last[k]
            start = k - (len(self.pieces[p]) if p >= 0 else 1)
            out.append((start, k, p))
            k = start
        return out[::-1]

    def encode_unit(self, text: str) -> list[int]:
        if self.kind == BPE:
            last, out, k = self._merge_path(text), [], len(text)
            while k and last[k] >= 0:
                out.append(last[k])
                k -= self._sizes[last[k]]
            if not k:
                return out[::-1]
        out = []
        before = 0
        for lo, hi, piece in self._path(text):
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in text[lo:hi].encode()]
            elif before != -1:  # unknown characters in a row are one piece
                out.append(self.unknown)
            before = piece
        return out

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        normal = self.normal(text)
        if not self.by_unit or not (self.bytes or self.unknown < 0):
            return array("i", self.encode_unit(normal)).tobytes()
        units = _UNIT.findall(normal)
        found = list(map(self._young.get, units))
        if None in found:
            new = {}
            for u in {u for u, f in zip(units, found) if f is None}:
                kept = self._old.get(u)
                new[u] = array("i", self.encode_unit(u)).tobytes() if kept is None else kept
            if len(self._young) + len(new) > CACHE_UNITS:
                self._old, self._young = self._young, {}
            if len(new) <= CACHE_UNITS:
                self._young.update(new)
            found = [new[u] if f is None else f for u, f in zip(units, found)]
        return b"".join(found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, without the blank that encoding put before the text."""
        out = b"".join(map(self.surface.__getitem__, ids))
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def model(path: str) -> PieceModel:
    """The model, once for each Python worker."""
    return PieceModel.load(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids, and restored: whether decoding the ids gives the text again, of every whole text."""
    session_of(docs)

    def run(batches):
        m = model(path)
        for b in in_slices(batches, "text", SLICE_BYTES):
            texts = texts_of(b.column("text"))
            parts = [m.encode_bytes(t) for t in texts]
            sizes = [len(p) // 4 for p in parts]
            ids = np.frombuffer(b"".join(parts), np.int32)
            at = np.cumsum([0, *sizes])
            restored = [m.decode_bytes(ids[x:y].tolist()) == t.encode() for x, y, t in zip(at, at[1:], texts)]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(restored)], ["doc_id", "n_pieces", "ids", "restored"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, restored boolean")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give null."""
    session_of(rows)

    def run(batches):
        m = model(path)
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
