"""Suffix arrays by induced sorting (SA-IS) and permuted common prefixes, in numpy.

Induction scans the array in blocks instead of entry by entry: up to the first slot that is still
empty all entries are final, so their predecessors can be placed together, by a stable sort over their
first symbols. A bucket fills in as many blocks as its longest run of one symbol.
"""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S type); the last symbol is the sentinel."""
    n = len(s)
    smaller = np.ones(n, dtype=bool)
    if n > 1:
        differs = np.append(s[:-1] != s[1:], True)
        at = np.where(differs, np.arange(n), n)
        following = np.minimum.accumulate(at[::-1])[::-1]
        less = np.append(s[:-1] < s[1:], True)
        smaller = less[following]
    return smaller


def _place(values: np.ndarray, symbols: np.ndarray):
    """Values grouped by symbol in stable order: (values, [symbol], [first of each], [number of each])."""
    n = len(values)
    if n == 1:
        return values, symbols, _ZERO, _ONE
    order = symbols.argsort(kind="stable")
    values, symbols = values[order], symbols[order]
    change = (symbols[1:] != symbols[:-1]).nonzero()[0]
    first = np.empty(len(change) + 1, dtype=np.int64)
    first[0] = 0
    first[1:] = change
    first[1:] += 1
    sizes = np.empty_like(first)
    sizes[:-1] = first[1:] - first[:-1]
    sizes[-1] = n - first[-1]
    return values, symbols[first], first, sizes


_ZERO, _ONE = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)


def _next_open(is_open: np.ndarray, at: int) -> int:
    """First bucket from ``at`` on that has an empty slot."""
    while at < len(is_open):
        found = int(is_open[at : at + 4096].argmax())
        if is_open[at + found]:
            return at + found
        at += 4096
    return len(is_open)


def _induce(s: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The array that follows from LMS suffixes in the given order."""
    n = len(s)
    end = np.cumsum(counts)
    start = end - counts
    large_count = np.bincount(s[~small], minlength=len(counts))
    array = np.full(n, -1, dtype=np.int32)
    steps = np.arange(n, dtype=np.int64)
    # LMS suffixes at the ends of their buckets, in order.
    values, symbols, first, sizes = _place(sorted_lms[::-1], s[sorted_lms[::-1]])
    array[np.repeat(end[symbols] - 1 + first, sizes) - steps[: len(values)]] = values

    head, stop = start.copy(), start + large_count
    is_open = large_count > 0
    i, at = 0, 0
    while i < n:
        at = _next_open(is_open, at)
        e = int(head[at]) if at < len(counts) else n
        block = array[i:e]
        before = block[block > 0] - 1
        before = before[~small[before]]
        if len(before):
            values, touched, first, sizes = _place(before, s[before])
            at_head = head[touched]
            array[(at_head - first).repeat(sizes) + steps[: len(values)]] = values
            at_head += sizes
            head[touched] = at_head
            is_open[touched] = at_head < stop[touched]
        i = e

    # The S part anew, from the right. The sentinel's suffix comes first of all.
    small_count = counts - large_count
    array[np.repeat(stop, small_count) + _runs(small_count)] = -1
    array[0] = n - 1
    tail = end.copy()
    stop = start + large_count
    stop[s[n - 1]] += 1
    is_open = (tail > stop)[::-1].copy()
    buckets = len(counts)
    last = np.int64(buckets - 1)
    i, at = n, 0
    while i > 0:
        at = _next_open(is_open, at)
        e = int(tail[buckets - 1 - at]) if at < buckets else 0
        block = array[e:i][::-1]
        before = block[block > 0] - 1
        before = before[small[before]]
        if len(before):
            values, touched, first, sizes = _place(before, s[before])
            at_tail = tail[touched]
            array[(at_tail - 1 + first).repeat(sizes) - steps[: len(values)]] = values
            at_tail -= sizes
            tail[touched] = at_tail
            is_open[last - touched] = at_tail > stop[touched]
        i = e
    return array


def _runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """For symbols 0..symbols-1; the last symbol is 0 and occurs once."""
    n = len(s)
    # Stable sorts of 16-bit numbers take linear time.
    s = s.astype(np.uint16 if symbols <= 1 << 16 else np.int32)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    small = _types(s)
    is_lms = np.concatenate(([False], small[1:] & ~small[:-1]))
    lms = np.flatnonzero(is_lms).astype(np.int32)
    counts = np.bincount(s, minlength=symbols)
    array = _induce(s, small, lms, counts)
    ordered = array[is_lms[array]]
    # Name the LMS substrings: equal to their neighbour in order, or new.
    length = np.zeros(n, dtype=np.int32)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = ordered[:-1], ordered[1:]
    equal = length[a] == length[b]
    left = np.flatnonzero(equal)
    step = 0
    while len(left):
        same = s[a[left] + step] == s[b[left] + step]
        equal[left[~same]] = False
        step += 1
        left = left[same & (step < length[a[left]])]
    names = np.concatenate(([0], np.cumsum(~equal)))
    if names[-1] + 1 < len(lms):
        place = np.zeros(n, dtype=np.int32)
        place[ordered] = names
        inner = _suffix_array(place[lms], int(names[-1]) + 1)
        ordered = lms[inner]
    return _induce(s, small, ordered, counts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array in order; a suffix that ends first is smaller."""
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    used = np.zeros(256, dtype=np.int64)
    used[text] = 1
    code = np.cumsum(used)  # 1.. for the symbols that occur
    s = np.append(code[text], 0)
    return _suffix_array(s, int(code[-1]) + 1)[1:]


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """For each text position, in text order, the bytes its suffix shares with its predecessor in the array.

    Counted up to ``most``; the first suffix of the array shares none.
    """
    n = len(text)
    common = np.zeros(n, dtype=np.int64)
    if n < 2:
        return common
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    padded = np.concatenate((text, np.zeros(most + 8, dtype=np.uint8)))
    word = np.ndarray((n + most,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
    live = np.flatnonzero(before >= 0)
    for offset in range(0, most, 8):
        differ = word[live + offset] ^ word[before[live] + offset]
        lowest = differ & (~differ + np.uint64(1))
        whole = differ == 0
        # Trailing zero bytes of the difference: the exponent of its lowest bit, in eights.
        bits = np.where(whole, 64, np.log2(np.where(whole, np.uint64(1), lowest).astype(np.float64)).astype(np.int64))
        common[live] += bits // 8
        live = live[whole]
    return np.minimum(np.minimum(common, most), n - np.arange(n))
