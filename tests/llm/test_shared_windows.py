"""Segments that share an anchor, beside the right result."""

import random

import numpy as np
import pyarrow as pa

from nichelens.llm import repeats


def test_segments_without_a_shared_window_are_not_sorted(monkeypatch):
    """Segments that have only the surroundings of their anchor in common stay out, others do not."""
    r = random.Random(5)
    letters = lambda n: bytes(r.choice(b"abcdefghij") for _ in range(n))
    texts = []
    for _ in range(60):
        middle = letters(20)
        texts += [letters(200) + middle + letters(200) for _ in range(3)]
        piece = letters(60)
        texts += [letters(100) + piece + letters(100) for _ in range(2)]
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    bound = np.cumsum(sizes)
    start, last, anchor, _ = repeats._segments(flat, np.repeat(bound, sizes), 50)
    owner = np.searchsorted(bound, start, side="right")
    order = np.argsort(anchor, kind="stable")
    start, last, anchor, owner = (x[order] for x in (start, last, anchor, owner))
    place = start - (bound - sizes)[owner]
    raw = [texts[o][p : p + n] for o, p, n in zip(owner, place, last - start + 50, strict=True)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array((anchor >> np.uint64(24)).astype(np.int64)), pa.array(owner), pa.array([[p] for p in place.tolist()], pa.list_(pa.int32())), pa.array(raw, pa.binary())],
        names=["a", "id", "starts", "bytes"],
    )
    sorted_bytes = []
    whole = repeats.shard_repeats
    monkeypatch.setattr(repeats, "shard_repeats", lambda text, *rest: sorted_bytes.append(len(text)) or whole(text, *rest))
    covered = set()
    for out in repeats._shards(50)([batch]):
        for d, a, b in zip(*(out.column(c).to_pylist() for c in ("id", "start", "stop")), strict=True):
            covered |= {(d, x) for x in range(a, b)}
    first: dict[bytes, int] = {}
    want = set()
    for d, text in enumerate(texts):
        for at in range(len(text) - 49):
            if first.setdefault(text[at : at + 50], d) < d:
                want |= {(d, x) for x in range(at, at + 50)}
    assert covered == want and want
    assert sum(sorted_bytes) < 0.3 * sum(map(len, raw))
