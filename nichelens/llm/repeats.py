"""Suffix-array dedup: remove each byte covered by a string of ``span`` bytes that also starts in a
document with a smaller id.

Shards by content. In every window of ``span`` bytes the leftmost 20-byte gram of least hash is its
anchor; equal windows have equal anchors, so all occurrences of a string meet under one key. The
consecutive windows of one anchor form a segment (some 65 bytes). Shorter grams make fewer segments, but more of
them meet by chance as the corpus grows, and the bytes of those travel.

1. Segments travel as (anchor, content hash, id, place), not as bytes. Within a map task equal segments
   are reduced to the least id before the shuffle. In sorted partitions, a segment equal to one of a
   smaller id is a repeat as a whole; of the rest, those whose anchor has different segments are kept.
2. Only the bytes of these travel, again by anchor, once for all equal segments of a document. A window
   shared with another document has its anchor at the same offset in both, so that the bytes around the anchor
   which all windows of a range of offsets hold are equal too; segments that share none of these with another
   document share no window and are left out. The rest goes to shards of ``SHARD_BYTES``. A shard's suffix array
   is induced (SA-IS) and its permuted common prefixes computed; runs with common prefixes of ``span``
   or more are equal windows, and those of larger ids than the run's least are repeats.
   An anchor with more than ``HOT`` different segments does not fit a shard: its windows are grouped by
   a 128-bit hash of their bytes instead, with map-side minima.
3. The repeats of each document are united, written, and cut from its text; by then nothing else is left on disk.

No group of segments or windows is gathered: sorted rows stream by, and hot keys are reduced before they
are shuffled. Ids are integers; rows without an id neither lose nor cause anything. Rows of one id never
remove each other, so repeated rows are treated alike. Null texts are empty. Matches never cross rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichelens.llm.common import mix64, slices, texts_of, tidy, with_id
from nichelens.llm.suffix_array import permuted_common_prefixes, suffix_array
from nichelens.session import discard, materialize

SPAN = 50
GRAM = 20
SHARD_BYTES = 3 << 19
HOT = 4096
#: Ranges of the anchor's offset in a window that are told apart before suffixes are sorted.
CUTS = 7
BLOCK = 1 << 20
#: Anchor hash bits in a key; the rest of the 128 bits tell segments of an anchor apart.
ANCHOR_BITS = 40

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALT = np.uint64(0xA0761D6478BD642F)


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on (zeros past the end) as one number."""
    padded = np.concatenate((buffer, np.zeros(8, dtype=np.uint8)))
    return np.ndarray((len(buffer),), dtype="<u8", buffer=padded.tobytes(), strides=(1,)).copy()


def _grams(word: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position on where there are as many; ``word`` is that of :func:`_words`."""
    n = len(word) - GRAM + 1
    gram = word[:n] * _BASE
    for at in (*range(8, GRAM - 8, 8), GRAM - 8):
        gram = mix64(gram + mix64(word[at : at + n] + _SALT)) * _BASE
    return mix64(gram)


def _segments(buffer: np.ndarray, ends: np.ndarray, span: int):
    """(start, last, anchor hash, content hash) of the segments of a buffer of documents.

    ``ends`` has, for each position, the end of its document. Windows [s, s+span) are those inside one.
    """
    n = len(buffer)
    reach = span - GRAM + 1
    if n < span:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    word = _words(buffer)
    gram = _grams(word)
    # The hash above, the place below: the least is the leftmost of the least.
    key = (gram >> np.uint64(23) << np.uint64(23)) | np.arange(len(gram), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < reach:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    windows = np.flatnonzero(np.arange(n - span + 1) + span <= ends[: n - span + 1])
    if not len(windows):
        return windows, windows, gram[:0], gram[:0]
    anchor = (low[windows] & np.uint64((1 << 23) - 1)).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)))
    first = np.flatnonzero(new)
    start = windows[first]
    last = windows[np.append(first[1:], len(windows)) - 1]
    # Hash of the bytes [start, last + span): a polynomial over mixed grams of eight bytes.
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE))))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE_INVERSE))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(word ^ _SALT) * powers[:-1])))
    stop = last + span - 7
    content = mix64((sums[stop] - sums[start]) * inverse[start] + (last - start).astype(np.uint64))
    return start, last, gram[anchor[first]], content


def _blocks(texts: list[bytes], ids: np.ndarray, span: int):
    """(buffer, ends, owner index, offset of the buffer in its text) for runs of whole texts, and for
    pieces of a very long text that overlap by one window less a byte."""
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) < span:
            continue
        if len(text) > BLOCK:
            for at in range(0, len(text) - span + 1, BLOCK):
                piece = text[at : at + BLOCK + span - 1]
                yield piece, [len(piece)], [i], [at]
            continue
        if size + len(text) > BLOCK and group:
            yield b"".join(texts[g] for g in group), [len(texts[g]) for g in group], group, [0] * len(group)
            group, size = [], 0
        group.append(i)
        size += len(text)
    if group:
        yield b"".join(texts[g] for g in group), [len(texts[g]) for g in group], group, [0] * len(group)


_ROW = "a long, b long, id long, start int, size int"


def _rows(a, b, ids, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids, pa.int64()),
            pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
        ],
        names=["a", "b", "id", "start", "size"],
    )


def _cut(span: int):
    """Map task of step 1: segments, with those equal to one of a smaller id in the block already as
    repeats, which have a negative size."""

    def run(batches):
        for part in slices(batches, BLOCK):
            texts = texts_of(part.column("text"))
            every = np.asarray(part.column("id"), dtype=np.int64)
            for raw, sizes, owners, offsets in _blocks(texts, every, span):
                sizes = np.array(sizes)
                bound = np.cumsum(sizes)
                buffer = np.frombuffer(raw, dtype=np.uint8)
                start, last, anchor, content = _segments(buffer, np.repeat(bound, sizes), span)
                if not len(start):
                    continue
                which = np.searchsorted(bound, start, side="right")
                ids = every[np.array(owners)][which]
                place = start - (bound - sizes)[which] + np.array(offsets)[which]
                size = last - start + span
                a = (anchor >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)) | (content >> np.uint64(ANCHOR_BITS))
                order = np.lexsort((ids, content, a))
                a, content, ids, place, size = (x[order] for x in (a, content, ids, place, size))
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (content[1:] != content[:-1])))
                least = ids[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
                repeat = ids > least
                b = np.where(repeat, mix64(content + ids.astype(np.uint64)), content)
                a = np.where(repeat, mix64(b + _SALT), a)  # repeats need no meeting place
                yield _rows(a, b, ids, place, np.where(repeat, -size, size))

    return run


_FOUND = "repeat boolean, a long, id long, start int, size int"


def _meet(batches):
    """Reduce task of step 1, over rows sorted by (a, b, size, id, start): repeats, and segments whose
    anchor has different segments. Carries the rows of an undecided last group to the next batch: those
    of one segment in one document, and no more."""
    shift = np.uint64(64 - ANCHOR_BITS)
    carry, decided = None, None  # rows (a, b, id, start, size) held back; anchor known to have several
    for batch in _closing(batches):
        if batch is None:
            if carry is None:
                return
            columns, final = carry, True
        else:
            columns = [np.asarray(batch.column(i)) for i in range(5)]
            final = False
            done = columns[4] < 0
            if done.any():
                yield _told(True, *(x[done] for x in columns))
                columns = [x[~done] for x in columns]
            if carry is not None:
                columns = [np.concatenate((x, y)) for x, y in zip(carry, columns, strict=True)]
        if not len(columns[0]):
            continue
        a, b, ids, start, size = columns
        anchor = a.view(np.uint64) >> shift
        new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        new = new_anchor | np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (size[1:] != size[:-1])))
        at = np.arange(len(a))
        least = ids[np.maximum.accumulate(np.where(new, at, 0))]
        repeat = ids > least
        first = np.flatnonzero(new_anchor)
        several = np.add.reduceat(new.astype(np.int64), first) > 1
        if decided is not None and anchor[0] == decided:
            several[0] = True
        group = np.cumsum(new_anchor) - 1
        head = ~repeat & several[group]
        carried = len(carry[0]) if carry is not None else 0
        told_before = np.zeros(len(a), dtype=bool)
        if decided is not None and anchor[0] == decided:
            told_before[:carried] = True
        if repeat.any():
            yield _told(True, *(x[repeat] for x in columns))
        fresh = head & ~told_before
        if fresh.any():
            yield _told(False, *(x[fresh] for x in columns))
        if final:
            return
        # Keep the last segment's first document, so that the next batch knows its least id.
        tail = np.flatnonzero(new)[-1]
        keep = np.flatnonzero((at >= tail) & ~repeat)
        if several[-1]:
            decided, keep = anchor[-1], keep[:1]
        else:
            decided = None
        carry = [x[keep] for x in columns]


def _closing(batches):
    yield from batches
    yield None


def _told(repeat: bool, a, b, ids, start, size) -> pa.RecordBatch:
    if repeat:
        a = np.zeros_like(a)  # nothing meets a repeat any more
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(a), repeat)), pa.array(a), pa.array(ids, pa.int64()), pa.array(start, pa.int32()),
            pa.array(np.abs(size), pa.int32()),
        ],
        names=["repeat", "a", "id", "start", "size"],
    )


def shard_repeats(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, stop) of what the windows of a shard cover that also stand in a segment of a smaller id.

    ``text`` holds the segments one after another. Windows that follow each other are one interval.
    """
    bound = np.cumsum(sizes)
    array = suffix_array(text)
    common = permuted_common_prefixes(text, array, span)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    whole = np.arange(len(text)) + span <= bound[owner]  # a window inside its segment
    run = np.cumsum(common[array] < span) - 1
    far = np.iinfo(np.int64).max
    own = np.where(whole, ids[owner], far)[array]
    least = np.minimum.reduceat(own, np.flatnonzero(np.diff(run, prepend=-1)))
    position = np.sort(array[(own != far) & (own > least[run])])
    if not len(position):
        return position, position, position
    new = np.concatenate(([True], (position[1:] != position[:-1] + 1) | (owner[position[1:]] != owner[position[:-1]])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(position)) - 1
    segment = owner[position[first]]
    begin = (bound - sizes)[segment]
    return segment, position[first] - begin, position[last] - begin + span


def sharing(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray, span: int) -> np.ndarray:
    """Whether each segment may share a window with one of another id: false only if it does not.

    ``text`` holds the segments one after another, all of each anchor that occurs.
    """
    begin = np.cumsum(sizes) - sizes
    word = _words(text)
    gram = _grams(word) >> np.uint64(23)
    # The anchor of all windows of a segment is that of its first, chosen as in _segments.
    anchor = begin + np.stack([gram[begin + i] for i in range(span - GRAM + 1)], axis=1).argmin(axis=1)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(text), _BASE))))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(text), _BASE_INVERSE))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[:-1])))
    kept = np.zeros(len(sizes), dtype=bool)
    for offsets in np.array_split(np.arange(span - GRAM + 1), CUTS):
        if not len(offsets):
            continue
        # What every window holds that has the anchor at one of these offsets.
        start, stop = anchor - offsets[0], anchor + span - offsets[-1]
        some = np.flatnonzero((start >= begin) & (stop <= begin + sizes))
        if not len(some):
            continue
        key = mix64((sums[stop[some]] - sums[start[some]]) * inverse[start[some]])
        order = np.argsort(key)
        key, some = key[order], some[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        several = np.minimum.reduceat(ids[some], first) < np.maximum.reduceat(ids[some], first)
        kept[some[np.repeat(several, np.diff(np.append(first, len(key))))]] = True
    return kept


def _spans(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["id", "start", "stop"]
    )


def _shards(span: int):
    """Step 2, over segments sorted by anchor: suffix arrays of shards of whole anchors."""

    def flush(kept):
        ids, starts, many, sizes, text = (np.concatenate(x) for x in zip(*kept, strict=True))
        segment, a, b = shard_repeats(text, sizes, ids, span)
        # What holds for a segment holds wherever it stands in its document.
        times = many[segment]
        at = np.repeat((np.cumsum(many) - many)[segment] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return _spans(np.repeat(ids[segment], times), starts[at] + np.repeat(a, times), starts[at] + np.repeat(b, times))

    def chosen(ids, starts, many, sizes, text):
        """The segments that may share a window with another document."""
        some = sharing(text, sizes, ids, span)
        return ids[some], starts[np.repeat(some, many)], many[some], sizes[some], text[np.repeat(some, sizes)]

    def run(batches):
        held: list[tuple] = []  # (anchor, id, starts, number of starts, size, bytes) of rows not yet looked at
        kept: list[tuple] = []  # (id, starts, number of starts, size, bytes) of rows not yet in a shard
        size, full = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("bytes")
            flat = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
            places = batch.column("starts")
            many = np.asarray(pc.list_value_length(places)).astype(np.int64)
            held.append((np.asarray(batch.column("a")), np.asarray(batch.column("id")), np.asarray(places.flatten()), many, np.asarray(pc.binary_length(raw)).astype(np.int64), flat))
            size += len(flat)
            if size < SHARD_BYTES // 2:
                continue
            anchor, ids, starts, many, sizes, text = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if cut:
                at, place = int(sizes[:cut].sum()), int(many[:cut].sum())
                kept.append(chosen(ids[:cut], starts[:place], many[:cut], sizes[:cut], text[:at]))
                full += len(kept[-1][-1])
                anchor, ids, starts, many, sizes, text = anchor[cut:], ids[cut:], starts[place:], many[cut:], sizes[cut:], text[at:]
            held, size = [(anchor, ids, starts, many, sizes, text)], len(text)
            if full >= SHARD_BYTES:
                yield flush(kept)
                kept, full = [], 0
        if size:
            kept.append(chosen(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:])))
        if sum(len(x[-1]) for x in kept):
            yield flush(kept)

    return run


def _united(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals of each owner as one, sorted."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    # Stops so far within an owner: shifted apart by owner, one running maximum does for all.
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + owner * far) - owner * far
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return owner[first], start[first], reach[np.append(first[1:], len(owner)) - 1]


def find_repeats(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, stop>>): the byte intervals to remove, united, of the documents that have any."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = source.where(F.col("id").isNotNull() & (F.octet_length("text") >= span))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = source.mapInArrow(tidy(_cut(span)), _ROW).repartition(parts, F.shiftrightunsigned("a", 64 - ANCHOR_BITS))
    met = dealt.sortWithinPartitions("a", "b", "size", "id", "start").mapInArrow(tidy(_meet), _FOUND)
    met = materialize(met, "segments")
    whole = met.where("repeat").select("id", "start", (F.col("start") + F.col("size")).alias("stop"))
    heads = met.where("NOT repeat").select(F.shiftrightunsigned("a", 64 - ANCHOR_BITS).alias("a"), "id", "start", "size")
    sized = heads.groupBy("a").agg(F.count("*").alias("n"))
    heads = heads.join(sized, "a").withColumn("hot", F.col("n") > HOT)
    wanted = heads.groupBy("id").agg(F.collect_list(F.struct("a", "start", "size", "hot")).alias("wanted"))
    texts = source.join(wanted.hint("shuffle_hash"), "id")

    def fetch(batches):
        for part in slices(batches):
            wanted = part.column("wanted")
            many = np.asarray(pc.list_value_length(wanted))
            fields = wanted.flatten()
            key, start, size, hot = (fields.field(c).to_pylist() for c in ("a", "start", "size", "hot"))
            texts = texts_of(part.column("text"))
            owner = np.repeat(np.arange(len(texts)), many).tolist()
            ids = np.repeat(np.asarray(part.column("id")), many)
            raw = [texts[o][a : a + n] for o, a, n in zip(owner, start, size, strict=True)]
            # Equal segments of a document travel once, with all their places.
            places: dict[tuple, list[int]] = {}
            for k in np.flatnonzero(~np.array(hot, dtype=bool)).tolist():
                if len(raw[k]) >= span:
                    places.setdefault((owner[k], raw[k]), []).append(k)
            one = [ks[0] for ks in places.values()]
            starts = pa.array([[start[k] for k in ks] for ks in places.values()], pa.list_(pa.int32()))
            rows = [pa.array([key[k] for k in one], pa.int64()), pa.nulls(len(one), pa.int64()), pa.array(ids[one]), starts, pa.array([raw[k] for k in one], pa.binary())]
            names = ["a", "b", "id", "starts", "bytes"]
            yield pa.RecordBatch.from_arrays(rows, names=names)
            lines: list[tuple] = []
            for k in np.flatnonzero(hot).tolist():
                for offset in range(len(raw[k]) - span + 1):
                    digest = hashlib.blake2b(raw[k][offset : offset + span], digest_size=16).digest()
                    halves = np.frombuffer(digest, dtype="<i8").tolist()
                    lines.append((*halves, int(ids[k]), start[k] + offset))
            if lines:
                a, b, i, at = zip(*lines, strict=True)
                rows = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(i, pa.int64()), pa.array([[x] for x in at], pa.list_(pa.int32())), pa.nulls(len(a), pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=names)

    fetched = materialize(texts.mapInArrow(tidy(fetch), "a long, b long, id long, starts array<int>, bytes binary"), "fetched")
    cool = fetched.where("b IS NULL").select("a", "id", "starts", "bytes").repartition(parts, "a").sortWithinPartitions("a")
    partly = cool.mapInArrow(tidy(_shards(span)), "id long, start int, stop int")
    hot = fetched.where("b IS NOT NULL").select("a", "b", "id", F.col("starts")[0].alias("start"))
    least = hot.groupBy("a", "b").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("a", "b", "least")
    hot = hot.join(least, ["a", "b"]).where("id > least").select("id", "start", (F.col("start") + span).alias("stop"))
    spans = whole.union(partly).union(hot).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def unite(batches):
        for batch in batches:
            spans = batch.column("spans")
            fields = spans.flatten()
            owner = np.repeat(np.arange(len(spans)), np.asarray(pc.list_value_length(spans)))
            owner, start, stop = _united(owner, *(np.asarray(fields.field(c)).astype(np.int64) for c in ("start", "stop")))
            pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "stop"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(spans))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pairs)], names=["id", "spans"])

    united = materialize(spans.mapInArrow(tidy(unite), "id long, spans array<struct<start:int,stop:int>>"), "repeats")
    discard(met, fetched)
    return united


def remove(
    docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
    whole_characters: bool = False,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row: what is left after the cut.

    ``row_col`` names what to return in place of the id, such as a struct of all columns; a ``text_col`` that is
    a field of it is not shuffled beside it. A cut may fall within a character; with ``whole_characters`` what is
    left of its bytes goes too.
    """
    found = find_repeats(docs, span, id_col, text_col).hint("shuffle_hash")
    source = docs.select(F.col(row_col or id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("key"))
    text = F.col("text")
    if row_col and text_col.startswith(f"{row_col}."):
        source, text = source.drop("text"), F.col("id" + text_col.removeprefix(row_col))
    joined = source.join(found.select(F.col("id").alias("key"), "spans"), "key", "left").select("id", text.alias("text"), "spans")
    kind = source.schema["id"].dataType

    def cut(batches):
        for part in slices(batches):
            sizes, removed, counts, kept = [], [], [], []
            for text, spans in zip(texts_of(part.column("text")), part.column("spans").to_pylist(), strict=True):
                pieces, at = [], 0
                for s in spans or ():
                    pieces.append(text[at : s["start"]])
                    at = s["stop"]
                pieces.append(text[at:])
                left = b"".join(pieces)
                if whole_characters and spans:
                    left = left.decode("utf-8", "ignore").encode()
                sizes.append(len(text))
                removed.append(len(text) - len(left))
                counts.append(len(spans or ()))
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    cut_rows = joined.mapInArrow(tidy(cut), with_id(kind, "n_bytes long, n_removed long, n_spans long, kept binary"))
    return cut_rows.withColumnRenamed("id", row_col or id_col)
