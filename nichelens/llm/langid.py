"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into segments of ``STEP`` bytes, lower-cased A-Z; a network of gated units runs over each
segment from both ends, and a linear layer labels every byte position with a language. A document's
probabilities are the mean over all its positions, so whole texts count. The squashing functions are
x / (1 + |x|), which have the shape of tanh at a fraction of its cost.

Training: backpropagation through time with Adam on a bounded sample, at most twice ``TRAIN_DOCS`` different
labelled texts a language with ``TRAIN_SEGMENTS`` segments each, spread over the whole text. Texts
are chosen by a hash of text and language; language, source and id are no inputs of a prediction. Only the sample
and the network (a few thousand numbers) pass through the driver.

Null texts and texts without a letter are ``und`` with score 0, as is everything when there was no
labelled row. Every row gives one row. Rows without an id count as held out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichelens.llm.common import LOWER, slices, texts_of, tidy, with_id

STEP = 64
UNITS = 8
TRAIN_DOCS, TRAIN_SEGMENTS = 300, 8
EPOCH_STEPS, BATCH = 350, 192
LANES = 4096
UNKNOWN = "und"


class Network(NamedTuple):
    """Weights of the two directions and of the output layer."""

    languages: list[str]
    inputs: list[np.ndarray]  # per direction (256, 3 units): update gate, reset gate, candidate
    states: list[np.ndarray]  # per direction (3 units, units)
    out: np.ndarray  # (languages, 2 units)
    bias: np.ndarray  # (languages, 1)


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def run_direction(codes: np.ndarray, table: np.ndarray, state: np.ndarray, keep: bool = False):
    """Hidden states (steps, units, lanes) for codes (steps, lanes); with ``keep`` also what backpropagation needs."""
    steps, lanes = codes.shape
    units = state.shape[1]
    hidden = np.zeros((steps + 1, units, lanes), dtype=np.float32)
    held = []
    transposed = np.ascontiguousarray(table.T)
    for t in range(steps):
        h = hidden[t]
        x = transposed[:, codes[t]]
        u = state @ h
        gates = x[: 2 * units] + u[: 2 * units]
        gates = squash(gates)
        z, r = 0.5 + 0.5 * gates[:units], 0.5 + 0.5 * gates[units:]
        c = squash(x[2 * units :] + r * u[2 * units :])
        hidden[t + 1] = c + z * (h - c)
        if keep:
            held.append((gates, z, r, c, u[2 * units :]))
    return hidden, held


def back_direction(codes, table, state, hidden, held, grad_hidden):
    """Gradients of the input table and the state matrix."""
    steps, lanes = codes.shape
    units = state.shape[1]
    d_state = np.zeros_like(state)
    d_x = np.empty((steps, 3 * units, lanes), dtype=np.float32)
    d_h = np.zeros((units, lanes), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        gates, z, r, c, uc = held[t]
        d_h = d_h + grad_hidden[t]
        h = hidden[t]
        d_c = d_h * (1 - z) * (1 - np.abs(c)) ** 2
        d_z = d_h * (h - c) * 0.5 * (1 - np.abs(gates[:units])) ** 2
        d_r = d_c * uc * 0.5 * (1 - np.abs(gates[units:])) ** 2
        d_x[t, :units], d_x[t, units : 2 * units], d_x[t, 2 * units :] = d_z, d_r, d_c
        d_u = np.concatenate((d_z, d_r, d_c * r))
        d_state += d_u @ h.T
        d_h = d_h * z + state.T @ d_u
    d_table = np.zeros_like(table)
    np.add.at(d_table, codes.ravel(), d_x.transpose(0, 2, 1).reshape(-1, 3 * units))
    return d_table, d_state


def label(net: Network, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities (steps, languages, lanes) for segments; ``lengths`` are their bytes."""
    forward, _ = run_direction(codes, net.inputs[0], net.states[0])
    backward, _ = run_direction(_turned(codes, lengths), net.inputs[1], net.states[1])
    scores = net.out[:, :UNITS] @ forward[1:] + net.bias
    # The backward state of position p was left after step length - 1 - p.
    at = lengths[None, :] - 1 - np.arange(codes.shape[0])[:, None]
    back = net.out[:, UNITS:] @ backward[1:]
    scores += np.take_along_axis(back, np.maximum(at, 0)[:, None, :], axis=0)
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _turned(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each lane's bytes in reverse order, padding last."""
    at = lengths[None, :] - 1 - np.arange(codes.shape[0])[:, None]
    return np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), axis=0), 0)


def _padded(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in segments])
    flat = b"".join(s.ljust(STEP, b"\0") for s in segments)
    return np.frombuffer(flat, dtype=np.uint8).reshape(-1, STEP), lengths


def train(sample: list[tuple[str, bytes]], languages: list[str], seed: int = 7) -> Network:
    """Fit the network to (language, segment) pairs; every language has the same weight."""
    rng = np.random.default_rng(seed)

    def start(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[-1]), shape).astype(np.float32)

    weights = [start(256, 3 * UNITS), start(256, 3 * UNITS), start(3 * UNITS, UNITS), start(3 * UNITS, UNITS), start(len(languages), 2 * UNITS), np.zeros((len(languages), 1), np.float32)]
    if len(languages) > 1:
        matrix, lengths = _padded([s for _, s in sample])
        owner = np.array([languages.index(name) for name, _ in sample])
        members = [np.flatnonzero(owner == i) for i in range(len(languages))]
        first = [np.zeros_like(w) for w in weights]
        second = [np.zeros_like(w) for w in weights]
        for step in range(1, EPOCH_STEPS + 1):
            chosen = np.concatenate([rng.choice(m, BATCH // len(languages) + 1) for m in members])
            codes, size, right = np.ascontiguousarray(matrix[chosen].T), lengths[chosen], owner[chosen]
            turned = _turned(codes, size)
            f, held_f = run_direction(codes, weights[0], weights[2], keep=True)
            b, held_b = run_direction(turned, weights[1], weights[3], keep=True)
            net = Network(languages, weights[:2], weights[2:4], weights[4], weights[5])
            at = size[None, :] - 1 - np.arange(STEP)[:, None]
            inside = at >= 0
            spot = np.maximum(at, 0)[:, None, :]
            back = np.take_along_axis(b[1:], spot, axis=0)
            both = np.concatenate((f[1:], back), axis=1)
            scores = net.out @ both + net.bias
            scores -= scores.max(axis=1, keepdims=True)
            p = np.exp(scores)
            p /= p.sum(axis=1, keepdims=True)
            p[:, right, np.arange(len(right))] -= 1
            p *= inside[:, None, :] / max(1, inside.sum())
            p = p.astype(np.float32)
            d_out = np.einsum("tcl,thl->ch", p, both, optimize=True)
            d_both = net.out.T @ p
            d_back = np.zeros_like(b[1:])
            # Positions map one to one to backward steps, padding all to step 0 with zero gradient.
            steps_of, lanes_of = np.nonzero(inside)
            d_back[at[steps_of, lanes_of], :, lanes_of] = d_both[steps_of, UNITS:, lanes_of]
            d_tf, d_sf = back_direction(codes, weights[0], weights[2], f, held_f, d_both[:, :UNITS])
            d_tb, d_sb = back_direction(turned, weights[1], weights[3], b, held_b, d_back)
            grads = [d_tf, d_tb, d_sf, d_sb, d_out, p.sum(axis=(0, 2))[:, None]]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = 0.03 * min(1.0, 2 * (1 - step / (EPOCH_STEPS + 1)))
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Network(languages, weights[:2], weights[2:4], weights[4], weights[5])


def _pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions of whole texts."""
    size = np.array([len(t) for t in texts])
    counts = -(-size // STEP)
    flat = np.frombuffer(b"".join(t.ljust(n * STEP, b"\0") for t, n in zip(texts, counts.tolist(), strict=True)), dtype=np.uint8)
    matrix = flat.reshape(-1, STEP)
    owner = np.repeat(np.arange(len(texts)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lengths = np.minimum(size[owner] - inner * STEP, STEP)
    total = np.zeros((len(texts), len(net.languages)))
    steps = np.arange(STEP)[:, None]
    for start in range(0, len(owner), LANES):
        part = slice(start, start + LANES)
        codes = np.ascontiguousarray(matrix[part].T)
        p = label(net, codes, lengths[part])
        p *= (steps < lengths[part])[:, None, :]
        summed = p.sum(axis=0)
        for i in range(len(net.languages)):
            total[:, i] += np.bincount(owner[part], summed[i], minlength=len(texts))
    return total / np.maximum(size, 1)[:, None]


def sample_segments(labelled: DataFrame) -> tuple[list[tuple[str, bytes]], list[str]]:
    """A bounded sample of (lang, segment) of a table (lang, text, pick), ``pick`` a hash of text and language; and
    the languages. Copies of a text count once: of each language the texts with the smallest picks are taken."""
    # Cut within each task before the shuffle, so that a frequent language is not gathered.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    smallest = labelled.select("lang", "pick").distinct().withColumn("place", place).where(F.col("place") <= 2 * TRAIN_DOCS)
    limits = {r["lang"]: r["limit"] for r in smallest.groupBy("lang").agg(F.max("pick").alias("limit")).collect()}
    if not limits:
        return [], []
    limit = F.create_map(*[x for k, n in limits.items() for x in (F.lit(k), F.lit(n).cast("long"))])
    # One of each text's copies; a task sends one at most.
    chosen = labelled.where(F.col("pick") <= limit[F.col("lang")]).groupBy("lang", "pick").agg(F.min("text").alias("text"))

    def cut(batches):
        for batch in batches:
            languages, segments = [], []
            picks = batch.column("pick").to_pylist()
            for name, raw, pick in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), picks, strict=True):
                raw = raw.translate(LOWER)
                rng = np.random.default_rng(pick & 0xFFFFFFFF)
                for at in sorted({int(x) for x in rng.integers(0, max(1, len(raw) - STEP + 1), TRAIN_SEGMENTS)}):
                    languages.append(name)
                    segments.append(raw[at : at + STEP])
            yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(segments, pa.binary())], names=["lang", "segment"])

    rows = chosen.select("lang", "text", "pick").mapInArrow(tidy(cut), "lang string, segment binary").collect()
    return sorted((r["lang"], bytes(r["segment"])) for r in rows if r["segment"]), sorted(limits)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on the rows with a text and a language; None if there are none."""
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(10), F.md5(F.col(text_col).cast("binary")), lang_col).alias("pick")
    ).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sample, languages = sample_segments(rows)
    return train(sample, languages) if sample else None


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    source = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    kind = source.schema["id"].dataType

    def run(batches):
        for part in slices(batches, 1 << 20):
            letters = np.array(part.column("letters").to_pylist(), dtype=bool)
            texts = [t.translate(LOWER) if a else b"" for t, a in zip(texts_of(part.column("text")), letters, strict=True)]
            if net is None:
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            else:
                p = _pooled(net, texts)
                names = [net.languages[i] if a else UNKNOWN for i, a in zip(p.argmax(axis=1), letters, strict=True)]
                scores = np.where(letters, np.minimum(p.max(axis=1), 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return source.mapInArrow(tidy(run), with_id(kind, "lang_pred string, score double")).withColumnRenamed("id", id_col)
