"""Phrases that stand together more often than their parts suggest, counted in a burstable trie.

Texts are cut into pieces and words; each position of a text is a path of the words that follow it. A task
inserts paths into a trie of word ids: the first level is a table of first words, below it stand hash
containers of path endings; a container that grows too large bursts into one container per next word. When
the trie holds too many endings, whole subtrees, the largest first, leave it as sorted runs of paths with
counts. Runs are dealt out by a prefix of the path, sorted, and merged: the count of a phrase is the sum
over its subtree.

Three passes: words; then hashes of pairs of frequent words, to see which pairs may be frequent; then the
trie, over paths whose pairs all may be. What may be frequent reaches the tasks as a bitmap of fixed size
over hashes: a false hit costs work and changes no count, and a bitmap that fills up only prunes less.

Null language: ``und``. Null and blank texts have no words. Equal rows count each. An empty table gives no
rows. Ties are ordered by count and phrase. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichelens.llm.common import mix64, slices, texts_of
from nichelens.session import materialize

UNKNOWN = "und"
#: For bytes: A-Z to lower case, tab to blank, what ends a piece to a line feed, all else as it is.
CUT = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\v\f\r" else c for c in range(256)
)
#: Bits of the bitmap of what is frequent.
FILTER_BITS = 1 << 26
_BLOCK = 1 << 15
#: Hashes of pairs that a task sorts at a time, and positions of the corpus for each part that they are dealt to.
CELLS, PART_POSITIONS = 4 << 20, 1 << 20
#: Endings that a task holds; then subtrees leave until half are left.
TRIE_ENDINGS = 500_000
#: Endings of one container; then it bursts.
CONTAINER_ENDINGS = 8_192
#: Words that a task remembers by number; then its trie leaves whole.
TASK_WORDS = 1_000_000


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of some texts as one array of bytes, and the number of the piece that each stands in."""
    data = np.frombuffer(b"\n".join(texts).translate(CUT), dtype=np.uint8)
    blank = (data == 32) | (data == 10)
    inside = np.concatenate(([False], ~blank, [False]))
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = turn[::2], turn[1::2]
    offsets = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank].tobytes())])
    return words, np.cumsum(data == 10)[start] if len(start) else start


def by_language(batches, limit: int = 4 << 20):
    """(language, words, pieces) of slices of the texts."""
    for part in slices(batches, limit):
        lang = part.column("lang").dictionary_encode()
        codes = np.asarray(lang.indices)
        texts = texts_of(part.column("text"))
        for k, name in enumerate(lang.dictionary.to_pylist()):
            words, piece = words_of([texts[i] for i in np.flatnonzero(codes == k).tolist()])
            if len(words):
                yield name, words, piece


def _rows(lang: list[str], phrase: list[bytes], n: list[int]):
    for at in range(0, len(n), 1 << 16):
        cut = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang[cut], pa.string()), pa.array(phrase[cut], pa.binary()), pa.array(n[cut], pa.int64())],
            names=["lang", "phrase", "n"],
        )


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n): words found ``least`` times or more; a row with a null phrase has all words of a language."""

    def run(batches):
        held: Counter = Counter()
        for lang, words, _ in by_language(batches):
            found = words.value_counts()
            held.update(dict(zip(((lang, w) for w in found.field("values").to_pylist()), found.field("counts").to_pylist(), strict=True)))
            held[lang, None] += len(words)
            if len(held) > TRIE_ENDINGS:
                yield from _rows([k[0] for k in held], [k[1] for k in held], list(held.values()))
                held.clear()
        yield from _rows([k[0] for k in held], [k[1] for k in held], list(held.values()))

    counts = texts.mapInArrow(run, "lang string, phrase binary, n long")
    counts = counts.groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))
    return materialize(counts.where((F.col("n") >= least) | F.col("phrase").isNull()), "words")


def frequent_bits(places: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` bits of the column ``place``; at most so many bits reach the driver."""
    block = F.col("place").bitwiseAND(-_BLOCK)
    bits = F.bitmap_construct_agg(F.col("place").bitwiseAND(_BLOCK - 1)).alias("bits")
    held = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in places.groupBy(block.alias("at")).agg(bits).toLocalIterator():
        held[row["at"] // 8 : row["at"] // 8 + _BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return held


def _set(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


class Trie:
    """First words, and below them containers of path endings: one hash table, or once burst one a next word.

    Endings are word numbers of four bytes each, high byte first, so that bytes sort as numbers do.
    """

    def __init__(self, container: int = CONTAINER_ENDINGS):
        self.container = container
        self.root: dict[int, Counter | dict[bytes, Counter]] = {}
        self.size: Counter = Counter()
        self.total = 0

    def add(self, first: np.ndarray, endings: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        first, keys = first[order], endings[order].tolist()
        bounds = np.flatnonzero(np.diff(first, prepend=-1, append=-1)).tolist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            word = int(first[a])
            node = self.root.get(word)
            if node is None:
                node = self.root[word] = Counter()
            if type(node) is Counter:
                node.update(keys[a:b])
                size = len(node)
                if size > self.container and len(keys[a]) > 4:
                    self.root[word] = self._burst(node)
            else:
                size = self.size[word]
                for key in keys[a:b]:
                    held = node.get(key[:4])
                    if held is None:
                        held = node[key[:4]] = Counter()
                    before = len(held)
                    held[key[4:]] += 1
                    size += len(held) - before
            self.total += size - self.size[word]
            self.size[word] = size

    @staticmethod
    def _burst(node: Counter) -> dict[bytes, Counter]:
        parts: dict[bytes, Counter] = {}
        for key, n in node.items():
            parts.setdefault(key[:4], Counter())[key[4:]] = n
        return parts

    def leave(self, until: int):
        """(first word, endings, counts) of whole subtrees, the largest first, each sorted."""
        for word, size in self.size.most_common():
            if self.total <= until:
                return
            node = self.root.pop(word)
            self.total -= self.size.pop(word)
            if type(node) is Counter:
                run = sorted(node.items())
            else:
                run = [(k + e, n) for k, held in sorted(node.items()) for e, n in sorted(held.items())]
            yield word, [k for k, _ in run], [n for _, n in run]


def numbered(known: dict[tuple[str, bytes], int], lang: str, words: pa.Array) -> np.ndarray:
    """Numbers of the words, from 1; new words are entered in ``known``."""
    coded = words.dictionary_encode()
    of = np.array([known.setdefault((lang, w), len(known) + 1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
    return of[np.asarray(coded.indices)]


class Numbered:
    """Words of a task by number, from 1, with a hash of each word and its language."""

    def __init__(self):
        self.known: dict[tuple[str, bytes], int] = {}
        self.sign = np.zeros(1, dtype=np.int64)

    def of(self, lang: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the words; new words are entered."""
        coded = words.dictionary_encode()
        known = self.known
        number = np.array([known.setdefault((lang, w), len(known) + 1) for w in coded.dictionary.to_pylist()], dtype=np.int64)
        if len(known) >= len(self.sign):
            fresh = [zlib.crc32(f"{g}\t".encode() + w) for g, w in islice(known, len(self.sign) - 1, None)]
            self.sign = np.append(self.sign, np.array(fresh, dtype=np.int64))
        ids = number[np.asarray(coded.indices)]
        return ids, self.sign[ids]


def _pairs_of(signs: np.ndarray, piece: np.ndarray, word_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word and next word, of one piece, both may be frequent; and the hashes of these pairs."""
    good = _set(word_bits, signs % FILTER_BITS)
    at = np.flatnonzero(good[:-1] & good[1:] & (piece[1:] == piece[:-1]))
    return at, mix64((signs[at] << 32 | signs[at + 1]).astype(np.uint64))


def pair_places(texts: DataFrame, word_bits, least: int, parts: int) -> DataFrame:
    """(place): bits of the hashes that ``least`` or more pairs of frequent words have.

    Hashes are counted per task and sent as sorted arrays, one a part and task; a part is summed at once. With
    about a million positions a part and 2^32 hashes in each, different pairs hardly ever share one.
    """

    def run(batches):
        numbered, held, size = Numbered(), [], 0

        def flush():
            nonlocal held, size
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            part = (cell >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, cell, n = part[order], cell[order].astype(np.uint32), n[order].astype(np.uint32)
            first = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            stop = np.append(first[1:], len(part))
            held, size = [], 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[first].astype(np.int32)),
                    pa.array([cell[i:j].tobytes() for i, j in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary()),
                    pa.array([n[i:j].tobytes() for i, j in zip(first.tolist(), stop.tolist(), strict=True)], pa.binary()),
                ],
                names=["part", "cells", "counts"],
            )

        for lang, words, piece in by_language(batches):
            if len(numbered.known) > TASK_WORDS:
                numbered = Numbered()
            _, cells = _pairs_of(numbered.of(lang, words)[1], piece, word_bits.value)
            held.append(cells)
            size += len(cells)
            if size > CELLS:
                yield from flush()
        if size:
            yield from flush()

    def add(batches):
        current, cells, counts = None, [], []

        def told():
            cell, turn = np.unique(np.concatenate(cells), return_inverse=True)
            total = np.bincount(turn, weights=np.concatenate(counts))
            place = cell[total >= least].astype(np.int64) % FILTER_BITS
            return pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])

        for batch in batches:
            for part, cell, n in zip(*[batch.column(c).to_pylist() for c in ("part", "cells", "counts")], strict=True):
                if part != current:
                    if cells:
                        yield told()
                    current, cells, counts = part, [], []
                cells.append(np.frombuffer(cell, np.uint32))
                counts.append(np.frombuffer(n, np.uint32))
        if cells:
            yield told()

    sent = texts.mapInArrow(run, "part int, cells binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "place long")


def path_counts(
    texts: DataFrame, longest: int, word_bits, pair_bits, held: int = TRIE_ENDINGS, container: int = CONTAINER_ENDINGS
) -> DataFrame:
    """(lang, path, n): pairs, and paths of three words to ``longest``, each word followed by a blank.

    A path ends with its piece, or before a pair that cannot be frequent, and stands for all its beginnings of
    three words or more; pairs are summed before they leave. Rows of one path may come from several runs.
    """
    endings = longest - 1

    def run(batches):
        trie, numbered = Trie(container), Numbered()

        def spill(until: int):
            spelled = [b""] + [w for _, w in numbered.known]
            of_lang = [""] + [g for g, _ in numbered.known]
            lang, path, n = [], [], []
            for word, keys, counts in trie.leave(until):
                ids = np.frombuffer(b"".join(keys), dtype=">i4").reshape(-1, endings)
                head = spelled[word] + b" "
                total = np.array(counts)
                first = np.flatnonzero(np.diff(ids[:, 0], prepend=0))
                path += [head + spelled[i] + b" " for i in ids[first, 0].tolist()]
                n += np.add.reduceat(total, first).tolist()
                deep = np.flatnonzero(ids[:, 1]) if endings > 1 else first[:0]
                path += [head + b" ".join([spelled[i] for i in row if i]) + b" " for row in ids[deep].tolist()]
                n += total[deep].tolist()
                lang += [of_lang[word]] * (len(first) + len(deep))
                if len(n) >= 1 << 16:
                    yield from _rows(lang, path, n)
                    lang, path, n = [], [], []
            yield from _rows(lang, path, n)

        for lang, words, piece in by_language(batches):
            if len(numbered.known) > TASK_WORDS:
                yield from spill(0)
                numbered = Numbered()
            ids, signs = numbered.of(lang, words)
            at, cells = _pairs_of(signs, piece, word_bits.value)
            link = np.zeros(len(ids), dtype=bool)
            link[at[_set(pair_bits.value, (cells & np.uint64(FILTER_BITS - 1)).astype(np.int64))]] = True
            # reach: how many words the path from a position has, the first included.
            reach = np.ones(len(ids), dtype=np.int64)
            for _ in range(endings):
                reach[:-1] = np.where(link[:-1], np.minimum(reach[1:] + 1, longest), 1)
            start = np.flatnonzero(link)
            if not len(start):
                continue
            step = np.arange(1, longest)
            tail = np.where(step < reach[start, None], ids[np.minimum(start[:, None] + step, len(ids) - 1)], 0)
            trie.add(ids[start], np.ascontiguousarray(tail.astype(">i4")).view(f"V{4 * endings}")[:, 0])
            if trie.total > held:
                yield from spill(held // 2)
        yield from spill(0)

    rows = texts.mapInArrow(run, "lang string, phrase binary, n long")
    return rows.select("lang", F.col("phrase").cast("string").alias("path"), "n")


def merged(paths: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, n): phrases of two words to ``longest`` with ``least`` or more occurrences.

    Runs are dealt out by their first three words and sorted; equal beginnings then stand together, and are
    summed batch by batch with one open sum a length carried on. A task holds a batch.
    """
    depths = range(2, longest + 1)
    dealt = paths.repartition(F.col("lang"), F.substring_index("path", " ", 3)).sortWithinPartitions("lang", "path")

    def beginning(k: int) -> Column:
        words = F.substring_index("path", " ", k)
        # A path of k words ends in a blank, so it has a k-th blank; a shorter one is given back whole.
        long = F.length(words) < F.length("path")
        if k == 2:  # pairs are counted by their own rows
            long = long & (F.length(words) + 1 == F.length("path"))
        return F.when(long, F.concat(F.col("lang"), F.lit("\t"), words)).alias(f"p{k}")

    def run(batches):
        open_: dict[int, tuple[str, int]] = {}
        for batch in batches:
            n = np.asarray(batch.column("n"))
            out: list[tuple[str, int]] = []
            for k in depths:
                column = batch.column(f"p{k}")
                has = np.flatnonzero(np.asarray(column.is_valid()))
                if not len(has):
                    continue
                runs = pc.run_end_encode(column.take(pa.array(has)))
                ends = np.asarray(runs.run_ends)
                sums = np.add.reduceat(n[has], np.concatenate(([0], ends[:-1])))
                values = runs.values
                if k in open_:
                    phrase, held = open_.pop(k)
                    if values[0].as_py() == phrase:
                        sums[0] += held
                    elif held >= least:
                        out.append((phrase, held))
                open_[k] = (values[len(values) - 1].as_py(), int(sums[-1]))
                done = np.flatnonzero(sums[:-1] >= least)
                out += zip(values.take(pa.array(done)).to_pylist(), sums[done].tolist(), strict=True)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out]), pa.array([s for _, s in out])], names=["key", "n"])
        out = [x for x in open_.values() if x[1] >= least]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([s for _, s in out], pa.int64())], names=["key", "n"])

    sums = dealt.select("n", *[beginning(k) for k in depths]).mapInArrow(run, "key string, n long")
    phrase = F.substring_index("key", "\t", -1)
    lang = F.substring("key", F.lit(1), F.length("key") - F.length(phrase) - 1)
    return sums.select(lang.alias("lang"), phrase.alias("phrase"), "n")


def frequent_phrases(
    docs: DataFrame, least: int, longest: int, lang_col: str = "lang", text_col: str = "text", **trie: int
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of words and phrases with ``least`` or more occurrences, and (lang, n) of all words."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(lang, F.col(text_col).alias("text"))
    spark = docs.sparkSession
    words = word_counts(texts, least)
    totals = words.where("phrase IS NULL").select("lang", "n")
    words = words.where("phrase IS NOT NULL")
    place = F.crc32(F.concat("lang", F.lit("\t"), "phrase").cast("binary")) % FILTER_BITS
    word_bits = spark.sparkContext.broadcast(frequent_bits(words.select(place.alias("place"))))
    positions = int(totals.agg(F.sum("n")).first()[0] or 0)
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), positions // PART_POSITIONS)
    pair_bits = spark.sparkContext.broadcast(frequent_bits(pair_places(texts, word_bits, least, parts)))
    found = materialize(merged(path_counts(texts, longest, word_bits, pair_bits, **trie), longest, least), "phrases")
    found = words.unionByName(found)
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    return found.select("lang", "phrase", size.alias("size"), F.col("n").alias("f")), totals


def scored_cuts(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, score, k, l, r, n, a): every phrase with its lowest-scoring cut, ties to the shortest first part.

    Products are exact decimals of 38 digits, and the quotient is a whole one.
    """
    phrases = grams.where("size >= 2")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k"))
    cut = cut.select("lang", "phrase", F.col("f").alias("a"), "k", first.alias("first"))
    cut = cut.withColumn("rest", F.substring("phrase", F.length("first") + 2, F.length("phrase")))
    part = lambda name, count: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.call_function("div", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), wide("l") * wide("r"))
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r", "n", "a")).alias("cut")
    return cut.groupBy("lang", "phrase").agg(weakest).select("lang", "phrase", "cut.*")


def mine(
    docs: DataFrame, least: int = 100, longest: int = 5, covered: int = 100, top: int | None = 2000,
    lang_col: str = "lang", text_col: str = "text", **trie: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases by the score of their weakest cut, best first.

    A phrase goes where a longer frequent one around it has ``covered`` hundredths of its occurrences or
    more; it suffices to look at phrases one word longer, as counts do not grow with length.
    """
    grams, totals = frequent_phrases(docs, least, longest, lang_col, text_col, **trie)
    phrases = grams.where("size >= 3")
    longer = phrases.select(
        "lang", F.col("f").alias("outer"),
        F.explode(F.array(*[F.call_function("substring_index", F.col("phrase"), F.lit(" "), k) for k in (F.col("size") - 1, 1 - F.col("size"))])).alias("phrase"),
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = scored_cuts(grams, totals).join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("outer") * 100 < F.col("a") * covered, F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
