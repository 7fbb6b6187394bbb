"""Alignment of two tokenizers over one corpus by inverted pair bitmaps.

Both tokenizers cut the same bytes; offsets at which a token of each ends cut them into groups, and the
two tokens that end there are linked. For every pair of ids the corpus keeps, chunk by chunk of documents,
a compressed bitmap of the documents that hold the pair, and planes for how often: plane p has the
documents where bit p of (links - 1) is set. Bitmaps are OR-merged and counted for the documents of a
pair, planes are counted for its links. The same postings carry the counts back to the documents.

A blank between a character that is none and one that is no white space begins a new group in both: the
pattern of a byte-level vocabulary always begins a match there, and no piece of the other goes on over it
(which is checked for each model). Texts are cut there, and each distinct stretch is encoded once.

A null or empty text, and one whose tokens do not spell a blank and the text, has no tokens: zeros, and
'' for its groups. Each row gives one row; equal rows count each. A text of any length is one document
of one chunk. Columns other than the id and the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import ChainMap
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from nichelens.llm.common import slices, with_id
from nichelens.session import materialize

#: Documents of a chunk; a dense bitmap has one bit for each.
CHUNK_DOCS = 32768
#: Links of a chunk, beyond which it ends with the document at hand.
CHUNK_LINKS = 1 << 20
#: Stretches of at most so many characters in each of a worker's two generations of memory.
MEMORY_STRETCHES, MEMORY_CHARS = 100_000, 64
_BLANKS, _CUTS = re.compile(r"^\s| (?:\s|$)"), re.compile(r"(?<=[^ ]) (?=\S)")
#: A bitmap of so many documents or more is dense; below it lists positions of two bytes.
DENSE = CHUNK_DOCS // 16


def _byte_level() -> dict[str, int]:
    """Sign of every byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer, with the bytes that each of its ids stands for."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.length = np.array([len(b) for b in spelled], dtype=np.int64)


class ByteLevel(Side):
    """A byte-level BPE in the file format of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        sign = _byte_level()
        with open(path, encoding="utf-8") as file:
            entries = json.load(file)["model"]["vocab"]
        spelled = [b""] * (1 + max(entries.values()))
        for entry, number in entries.items():
            if all(c in sign for c in entry):
                spelled[number] = bytes(sign[c] for c in entry)
        super().__init__(spelled)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece model, which puts a blank before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            byte = self.model.is_byte(number)
            spelled.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"{path}: piece {piece!r} goes on over a blank")
        super().__init__(spelled)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Stretches:
    """Tokens of stretches of text, cut into groups: for each (tokens, tokens, links, groups), or None if they do not fit.

    Links are packed 64-bit numbers, the id of the first side in the upper half; groups are the text that is hashed.
    """

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        size = max(len(a.spelled), len(b.spelled))
        # Every id spelled with each of the signs that may follow it.
        self.names = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(size)]
        self.size = size
        # Two generations: what is used again moves from the old one to the new one.
        self.memory: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def cut(self, text: str) -> list[str]:
        """Stretches, each without the blank that it begins with."""
        return text.split(" ") if _BLANKS.search(text) is None else _CUTS.split(text)

    def of(self, texts: list[str]) -> list[list[tuple | None]]:
        parts = [self.cut(t) if t else [] for t in texts]
        wanted = set(chain.from_iterable(parts)) - self.memory.keys()
        if len(self.memory) + len(wanted) > MEMORY_STRETCHES:
            self.old, self.memory = self.memory, {}
            wanted = set(chain.from_iterable(parts))
        again = wanted & self.old.keys()
        self.memory.update((w, self.old[w]) for w in again)
        held = self.memory
        fresh = list(wanted - again)
        long = {}
        for at in range(0, len(fresh), 8192):
            for w, found in self.align(fresh[at : at + 8192]):
                (held if len(w) <= MEMORY_CHARS else long)[w] = found
        if long:
            held = ChainMap(long, held)
        return [[held[w] for w in p] for p in parts]

    def align(self, stretches: list[str]) -> list[tuple[str, tuple | None]]:
        """Each stretch with its tokens. Stretches between which texts are cut are encoded together."""
        plain = [w for w in stretches if not w[0].isspace() and w[-1] != " "]
        groups = [plain[at : at + 128] for at in range(0, len(plain), 128)]
        groups += [[w] for w in stretches if w[0].isspace() or w[-1] == " "]
        found = self._aligned(groups)
        # A group that does not fit as a whole is looked at one by one.
        wrong = [g for g, told in zip(groups, found, strict=True) if told is None]
        single = [[w] for g in wrong if len(g) > 1 for w in g]
        out = [x for told in found if told is not None for x in told]
        out += [(g[0], None) for g in wrong if len(g) == 1]
        if single:
            out += [(g[0], told[0][1] if told else None) for g, told in zip(single, self._aligned(single), strict=True)]
        return out

    def _aligned(self, groups: list[list[str]]) -> list[list[tuple[str, tuple]] | None]:
        texts = [" ".join(g) for g in groups]
        ids = [side.encode(texts) for side in self.sides]
        fits = [
            all([b"".join([side.spelled[i] for i in x]) == raw for side, x in zip(self.sides, both, strict=True)])
            for raw, both in zip((b" " + t.encode() for t in texts), zip(*ids, strict=True), strict=True)
        ]
        words = [w for g, ok in zip(groups, fits, strict=True) if ok for w in g]
        flat = [
            np.array(list(chain.from_iterable(x for x, ok in zip(side, fits, strict=True) if ok)), dtype=np.int64) for side in ids
        ]
        # What fits has the same bytes on both sides, so that offsets agree throughout.
        ends = [np.cumsum(side.length[f]) for side, f in zip(self.sides, flat, strict=True)]
        stop = np.cumsum([1 + len(w.encode()) for w in words], dtype=np.int64)
        both = np.ones(int(stop[-1]) + 1 if len(stop) else 1, dtype=bool)
        for e in ends:
            mark = np.zeros(len(both), dtype=bool)
            mark[e] = True
            both &= mark
        if not both[stop].all():
            raise ValueError("a token goes on over a blank before a word")
        passed = np.cumsum(both)
        last = [np.flatnonzero(both[e]) for e in ends]
        link = flat[0][last[0]] << 32 | flat[1][last[1]]
        group = [passed[e - 1] for e in ends]  # common ends before a token's own
        count = [np.bincount(g, minlength=len(link)) for g in group]
        close = [np.zeros(len(f), dtype=np.int64) for f in flat]
        for c, k in zip(close, last, strict=True):
            c[k] = 1
        # Tokens of a group stand together, those of the first side in front.
        spelled = np.empty(len(flat[0]) + len(flat[1]), dtype=np.int64)
        spelled[np.arange(len(flat[0])) + (np.cumsum(count[1]) - count[1])[group[0]]] = flat[0] + self.size * close[0]
        spelled[np.arange(len(flat[1])) + np.cumsum(count[0])[group[1]]] = flat[1] + 2 * self.size * close[1]
        names = self.names
        parts = [names[i] for i in spelled.tolist()]
        n = [np.diff(np.searchsorted(e, stop, side="right"), prepend=0).tolist() for e in ends]
        links = np.diff(passed[stop], prepend=0).tolist()
        raw, at, seen = link.tobytes(), 0, 0
        told = []
        for w, x, y, m in zip(words, *n, links, strict=True):
            told.append((w, (x, y, raw[8 * seen : 8 * (seen + m)], b"".join(parts[at : at + x + y])[:-1])))
            at, seen = at + x + y, seen + m
        out, turn = [], 0
        for g, ok in zip(groups, fits, strict=True):
            out.append(told[turn : turn + len(g)] if ok else None)
            turn += len(g) if ok else 0
        return out


_LOADED: dict[tuple[str, str], Stretches] = {}


def loaded(path_a: str, path_b: str) -> Stretches:
    """Both tokenizers of a worker, read once from the files that every node holds."""
    key = (path_a, path_b)
    if key not in _LOADED:
        _LOADED[key] = Stretches(ByteLevel(path_a), Pieces(path_b))
    return _LOADED[key]


def bitmaps(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Distinct keys, and for each the compressed bitmap of its documents; (key, doc) sorted and distinct."""
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(np.append(first, len(key)))
    dense = np.flatnonzero(n >= DENSE)
    width = np.where(n >= DENSE, CHUNK_DOCS // 8, 2 * n)
    offsets = np.concatenate(([0], np.cumsum(width)))
    data = np.zeros(offsets[-1], dtype=np.uint8)
    sparse = np.repeat(n < DENSE, n)
    at = np.repeat(offsets[:-1] - 2 * first, n)[sparse] + 2 * np.flatnonzero(sparse)
    data[at], data[at + 1] = doc[sparse] & 255, doc[sparse] >> 8
    for k in dense.tolist():
        bits = np.zeros(CHUNK_DOCS, dtype=np.uint8)
        bits[doc[first[k] : first[k] + n[k]]] = 1
        data[offsets[k] : offsets[k + 1]] = np.packbits(bits)
    column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return key[first], column


def members(data: bytes) -> np.ndarray:
    """Documents of a compressed bitmap, in order."""
    if len(data) == CHUNK_DOCS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)))
    return np.frombuffer(data, dtype="<u2").astype(np.int64)


def population(column: str):
    """How many documents a compressed bitmap holds."""
    size = F.length(column)
    return F.when(size == CHUNK_DOCS // 8, F.bitmap_count(column)).otherwise((size / 2).cast("long"))


def postings(pair: np.ndarray, doc: np.ndarray) -> pa.Table:
    """(pair, plane, docs) of one chunk: plane -1 is the documents of the pair, plane p bit p of (links - 1)."""
    cell, times = np.unique(pair * np.int64(CHUNK_DOCS) + doc, return_counts=True)
    pair, doc, more = cell // CHUNK_DOCS, cell % CHUNK_DOCS, times - 1
    parts = []
    for plane in range(-1, int(more.max(initial=0)).bit_length()):
        held = slice(None) if plane < 0 else np.flatnonzero(more >> plane & 1)
        keys, docs = bitmaps(pair[held], doc[held])
        parts.append(pa.table([pa.array(keys), pa.array(np.full(len(keys), plane, dtype=np.int32)), docs], ["pair", "plane", "docs"]))
    return pa.concat_tables(parts)


def _encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents and rows of postings, in one table, chunk by chunk.

    A chunk is the work of one task; its number is made of the task's partition and a running number.
    """
    kind = docs.schema["id"].dataType
    names = ["id", "chunk", "pos", "n_a", "n_b", "n_groups", "groups_sha256", "pair", "plane", "docs"]

    def run(batches):
        stretches = loaded(path_a, path_b)
        chunk, filled, links = TaskContext.get().partitionId() << 24, 0, 0
        pairs, places = [], []

        def close():
            found = postings(np.concatenate(pairs), np.concatenate(places)) if pairs else postings(np.zeros(0, np.int64), np.zeros(0, np.int64))
            for part in found.combine_chunks().to_batches(max_chunksize=1 << 16):
                m = part.num_rows
                blank = [pa.nulls(m, pa.int64()) for _ in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, to_arrow_type(kind)), pa.array(np.full(m, chunk)), *blank, pa.nulls(m, pa.string()), *part.columns], names=names
                )

        for part in slices(batches, 2 << 20):
            for at in range(0, part.num_rows, CHUNK_DOCS):
                some = part.slice(at, CHUNK_DOCS)
                m = some.num_rows
                if filled and (filled + m > CHUNK_DOCS or links >= CHUNK_LINKS):
                    yield from close()
                    chunk, filled, links, pairs, places = chunk + 1, 0, 0, [], []
                told = []
                for k, found in enumerate(stretches.of([t or "" for t in some.column("text").to_pylist()])):
                    if not found or None in found:
                        told.append((0, 0, 0, ""))
                        continue
                    packed = b"".join([x[2] for x in found])
                    pairs.append(np.frombuffer(packed, dtype=np.int64))
                    m_links = len(packed) // 8
                    places.append(np.full(m_links, filled + k, dtype=np.int64))
                    links += m_links
                    groups = hashlib.sha256(b";".join([x[3] for x in found])).hexdigest()
                    told.append((sum([x[0] for x in found]), sum([x[1] for x in found]), m_links, groups))
                cells = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("id"), pa.array(np.full(m, chunk)), pa.array(np.arange(filled, filled + m)), *cells,
                        pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()),
                    ],
                    names=names,
                )
                filled += m
        if filled:
            yield from close()

    rest = "chunk long, pos long, n_a long, n_b long, n_groups long, groups_sha256 string, pair long, plane int, docs binary"
    return materialize(docs.mapInArrow(run, with_id(kind, rest)), "aligned")


def pair_counts(posted: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best): documents and links of every pair, and whether no pair with its id on
    the second side has more links. Ids of that side are as many as its vocabulary has, whatever the corpus.
    """
    held = population("docs")
    links = F.when(F.col("plane") < 0, held).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("plane")) * held)
    counted = posted.groupBy("pair").agg(
        F.sum(F.when(F.col("plane") < 0, held).otherwise(0)).alias("n_docs"), F.sum(links).alias("n_links")
    )
    counted = materialize(counted, "pairs").withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = counted.groupBy("b").agg(F.max("n_links").alias("top"))
    return counted.join(top, "b").select("pair", "n_docs", "n_links", (F.col("n_links") == F.col("top")).alias("best"))


def _returned(scored: DataFrame) -> DataFrame:
    """(chunk, pos, n_best, count_sum): counts of the pairs carried back to the documents of their postings."""

    def run(batches):
        def told(chunk, best, total):
            held = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), chunk)), pa.array(held), pa.array(best[held]), pa.array(total[held])],
                names=["chunk", "pos", "n_best", "count_sum"],
            )

        current, best, total = None, None, None
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("chunk", "plane", "docs", "n_links", "best")]
            for chunk, plane, docs, n_links, is_best in zip(*columns, strict=True):
                if chunk != current:
                    if current is not None:
                        yield told(current, best, total)
                    current, best, total = chunk, np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
                at = members(docs)
                weight = 1 << max(plane, 0)
                total[at] += weight * n_links
                if is_best:
                    best[at] += weight
        if current is not None:
            yield told(current, best, total)

    dealt = scored.repartition(F.col("chunk")).sortWithinPartitions("chunk")
    return dealt.mapInArrow(run, "chunk long, pos long, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    Token ids of both sides must be below 2^31. Pairs are shuffled as bitmaps of a chunk; a pair has one
    row a plane and chunk, however many documents hold it.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = _encoded(source, path_a, path_b)
    posted = both.where("pair IS NOT NULL").select("chunk", "pair", "plane", "docs")
    scored = posted.join(pair_counts(posted), "pair").select("chunk", "plane", "docs", "n_links", "best")
    rows = both.where("pos IS NOT NULL").select("id", "chunk", "pos", "n_a", "n_b", "n_groups", "groups_sha256")
    back = _returned(scored)
    none = F.lit(0).cast("long")
    return rows.join(back, ["chunk", "pos"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )


def pairs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, n_links, best): the alignment table of the two vocabularies."""
    both = _encoded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path_a, path_b)
    counted = pair_counts(both.where("pair IS NOT NULL").select("chunk", "pair", "plane", "docs"))
    a, b = F.shiftrightunsigned("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b")
    return counted.select(a, b, "n_docs", "n_links", "best")
