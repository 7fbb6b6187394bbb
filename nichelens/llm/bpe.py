"""Byte-level BPE: encoding and decoding by a file of ranks.

A text is cut by the tokenizer's pattern; each *distinct* piece is merged once. The pieces of one
length bucket form a padded matrix of token ids; in every round each row merges its leftmost pair of
minimum rank, ranks are looked up in an open-addressing hash table of pairs, and rows without a
further merge leave the matrix. Pieces beyond ``MATRIX_BYTES`` (runs without blanks) would need a
round per merge over a huge row; a heap of pairs gives the same merges in n log n.

Null text: no ids. Empty text: no ids. Text of any length is encoded whole. Ids outside the
vocabulary, and null id lists, decode to nothing. Each input row gives one output row.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichelens.llm.common import release, slices, with_id

MATRIX_BYTES = 256
#: Pieces, and words, in each of a worker's two generations of memory; what is used again moves to the new one.
MEMORY_PIECES = 100_000
_NONE = np.int32(1 << 30)
_SIGNS = frozenset(".,;:!?")
_BLANKS, _WORDS = regex.compile(r" (?:\s|$)"), regex.compile(r" (?=\S)")


def vocabulary(path: str) -> list[bytes]:
    """Tokens by rank; a rank that the file leaves out is empty."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    token = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for text, rank in pairs:
        token[int(rank)] = base64.b64decode(text)
    return token


class Ranks:
    """A vocabulary of byte strings by rank, with a hash table of the pairs that merge."""

    def __init__(self, path: str):
        self.token = vocabulary(path)
        self.rank = {token: rank for rank, token in enumerate(self.token) if token}
        self.length = [len(t) for t in self.token]
        self.single = np.array([self.rank[bytes([c])] for c in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self._build(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))
        # Ids of pieces and of blank-led words met so far, as packed 32-bit numbers.
        self.memory: dict[str, bytes] = {}
        self.old_memory: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the memory of pieces and words."""
        self.memory, self.old_memory, self.words, self.old_words = {}, {}, {}, {}

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing with linear probing, all keys placed in vectorised rounds."""
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slot_key = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_rank = np.full(1 << bits, _NONE, dtype=np.int32)
        at, rest = self._home(keys), np.arange(len(keys))
        self.probes = 0
        while len(rest):
            self.probes += 1
            free = rest[self.slot_rank[at[rest]] == _NONE]
            self.slot_key[at[free]] = keys[free]
            won = free[self.slot_key[at[free]] == keys[free]]
            self.slot_rank[at[won]] = values[won]
            placed = np.zeros(len(keys), dtype=bool)
            placed[won] = True
            rest = rest[~placed[rest]]
            at[rest] = (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, or _NONE. Negative ids never merge."""
        keys = left.astype(np.uint32).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        at = self._home(keys)
        found = np.full(keys.shape, _NONE, dtype=np.int32)
        hit = self.slot_key[at] == keys
        found[hit] = self.slot_rank[at[hit]]
        open_ = np.nonzero(~hit & (self.slot_rank[at] != _NONE))
        for _ in range(self.probes):
            if not len(open_[0]):
                break
            at[open_] = (at[open_] + 1) & self.mask
            spot = at[open_]
            hit = self.slot_key[spot] == keys[open_]
            won = tuple(x[hit] for x in open_)
            found[won] = self.slot_rank[spot[hit]]
            more = ~hit & (self.slot_rank[spot] != _NONE)
            open_ = tuple(x[more] for x in open_)
        return found

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as packed 32-bit numbers, of pieces of similar length (two bytes or more)."""
        count, width = len(pieces), max(map(len, pieces))
        size = np.array([len(p) for p in pieces])
        ids = np.full((count, width), -1, dtype=np.int32)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:])
        ranks[~inside[:, 1:]] = _NONE
        out = [b""] * count
        row = np.arange(count)
        while len(row):
            best = ranks.argmin(axis=1)  # the leftmost of equals
            rank = np.take_along_axis(ranks, best[:, None], 1)[:, 0]
            done = rank == _NONE
            if done.any():
                lines, step = ids[done].tobytes(), 4 * ids.shape[1]
                for i, (r, n) in enumerate(zip(row[done].tolist(), size[done].tolist(), strict=True)):
                    out[r] = lines[i * step : i * step + 4 * n]
                keep = ~done
                row, ids, ranks, size, best, rank = (x[keep] for x in (row, ids, ranks, size, best, rank))
                if not len(row):
                    break
                width = int(size.max())
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
            lines = np.arange(len(row))
            # Close the gap behind the merged pair, then look up the two pairs beside the new token.
            column = np.arange(width - 1)
            ids[:, :-1] = np.where(column > best[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[lines, best] = rank
            if width > 2:
                ranks[:, :-1] = np.where(column[:-1] > best[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            size = size - 1
            for side in (best - 1, best):
                ok = np.flatnonzero((side >= 0) & (side + 1 < size))
                at = side[ok]
                ranks[ok, at] = self.pair_rank(ids[ok, at], ids[ok, at + 1])
            last = np.flatnonzero(best + 1 >= size)
            ranks[last, np.minimum(best[last], width - 2)] = _NONE
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, by a heap of pairs over a linked list."""
        part = [self.rank[bytes([c])] for c in piece]
        last = len(part)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        rank, token = self.rank, self.token

        def pair(i: int) -> int | None:
            j = after[i]
            return rank.get(token[part[i]] + token[part[j]]) if j < last else None

        heap = [(r, i) for i in range(last - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if part[i] < 0 or pair(i) != r:
                continue
            j = after[i]
            part[i], part[j] = r, -1
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
            for side in (i, before[i]):
                if side >= 0 and (new := pair(side)) is not None:
                    heapq.heappush(heap, (new, side))
        return np.array([x for x in part if x >= 0], dtype="<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that the memory does not hold yet."""
        new = pieces - self.memory.keys()
        if len(self.memory) + len(new) > MEMORY_PIECES:
            self.old_memory, self.memory = self.memory, {}
            new = pieces
        new = _again(new, self.memory, self.old_memory)
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                self.memory[piece] = whole.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.memory[piece] = self.merge_long(raw)
            else:
                bucket = (len(raw) - 1) // 4 if len(raw) <= 32 else 8 + (len(raw) - 1) // 32
                buckets.setdefault(bucket, []).append((piece, raw))
        for members in buckets.values():
            for start in range(0, len(members), 8192):
                part = members[start : start + 8192]
                self.memory.update(
                    zip((p for p, _ in part), self.merge_matrix([r for _, r in part]), strict=True)
                )

    def encode(self, texts: list[str], pattern: regex.Pattern) -> list[bytes]:
        """Ids of whole texts, packed.

        A blank before a character that is no white space always begins a match of ``PATTERN``, so a
        text may be cut there; what stands between two such blanks is looked up as one string. With
        another pattern texts are matched as they are.
        """
        if pattern.pattern != PATTERN:
            matched = [pattern.findall(t) for t in texts]
            self.learn(set().union(*matched))
            return [b"".join([self.memory[p] for p in m]) for m in matched]
        cut = [t.split(" ") if _BLANKS.search(t) is None else _WORDS.split(t) for t in texts]
        first = [pattern.findall(c.pop(0)) for c in cut]
        wanted: set[str] = set().union(*cut)
        fresh = wanted - self.words.keys()
        if len(self.words) + len(fresh) > MEMORY_PIECES:
            self.old_words, self.words = self.words, {}
            fresh = wanted
        fresh = _again(fresh, self.words, self.old_words)
        spaced = [(w, _simple(w) or pattern.findall(" " + w)) for w in fresh]
        self.learn(set().union(*[p for _, p in spaced], *first))
        memory, seen = self.memory, self.words
        for word, pieces in spaced:
            seen[word] = b"".join([memory[p] for p in pieces])
        piece, word = memory.__getitem__, seen.__getitem__
        return [b"".join(chain(map(piece, head), map(word, rest))) for head, rest in zip(first, cut, strict=True)]


def _simple(word: str) -> list[str] | None:
    """Matches of ``PATTERN`` in a blank and a word of Latin letters, which may end in a sign; None for others."""
    end = word[-1:]
    stem = word[:-1] if end in _SIGNS else word
    if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
        return [" " + stem, end] if stem is not word else [" " + word]
    return None


def _again(wanted: set[str], new: dict[str, bytes], old: dict[str, bytes]) -> set[str]:
    """Move what the old generation holds of ``wanted`` to the new one; the rest is returned."""
    known = wanted & old.keys()
    new.update((w, old[w]) for w in known)
    return wanted - known


_SPELLED: dict[str, list[bytes]] = {}
_LOADED: dict[tuple[str, str], tuple[Ranks, regex.Pattern]] = {}


def loaded(path: str, pattern: str) -> tuple[Ranks, regex.Pattern]:
    """The vocabulary of a worker, read once from the file that every node holds."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = (Ranks(path), regex.compile(pattern))
    return _LOADED[key]


def _encoded(batches, path: str, pattern: str):
    """Batches (id, ids) of batches (id, text). A worker serves other tasks later: it gives its memory back."""
    ranks, compiled = loaded(path, pattern)
    try:
        for part in slices(batches, 1 << 20):
            found = ranks.encode([t or "" for t in part.column("text").to_pylist()], compiled)
            flat = np.frombuffer(b"".join(found), dtype="<i4")
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column("id"), ids], names=["id", "ids"])
    finally:
        ranks.forget()
        release()


def _decoded(batches, path: str):
    """Batches (id, ids, decoded) of batches (id, ids)."""
    if path not in _SPELLED:
        _SPELLED[path] = vocabulary(path)
    token = _SPELLED[path]
    size = len(token)

    def spell(ids: np.ndarray) -> bytes:
        if len(ids) and (ids.min() < 0 or ids.max() >= size):
            ids = ids[(ids >= 0) & (ids < size)]
        return b"".join([token[i] for i in ids.tolist()])

    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            lists = part.column("ids")
            flat = np.asarray(pc.fill_null(lists.flatten(), -1))
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            texts = [spell(x) for x in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), lists, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"]
            )


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of each whole text, without special tokens.

    Other columns of ``docs`` are not read, so none can clash.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    found = source.mapInArrow(lambda batches: _encoded(batches, path, pattern), with_id(kind, "ids array<int>"))
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes that each list of ids stands for."""
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = source.schema["id"].dataType
    found = source.mapInArrow(lambda batches: _decoded(batches, path), with_id(kind, "ids array<int>, decoded binary"))
    return found.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What :func:`decode` gives of what :func:`encode` gives, in one worker a task instead of two."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType

    def run(batches):
        return _decoded(_encoded(batches, path, pattern), path)

    return source.mapInArrow(run, with_id(kind, "ids array<int>, decoded binary")).withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of a decoded table."""
    ids: Column = F.col("ids")
    return decoded.select(
        F.col(id_col),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
