"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on windows of a bounded
sample of labelled texts. It reads the bytes of a text in both directions, across white space and
all else, and gives every byte position a probability for each language. A document's probabilities
are the mean over all its positions.

A text is read in stretches of at most STRETCH bytes, each begun and ended RUN_IN bytes early and
late for the sake of the states: the two directions run through all of a stretch, a text of up to
STRETCH bytes is one, and in a longer one what was read does not hold the label where the language
changes. Stretches of many texts are read side by side, so a long text costs no more steps than a
short one, and memory is bounded by the positions that are read at a time.

Defined results: a null text and a text without a letter get UND with score 0; a table without any
labelled row to learn from gives UND for every row; equal means go to the language first in order;
repeated rows each keep their row; input columns stay, except those named as the output; an empty
table gives an empty table; more than MOST_LANGUAGES languages are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, with_text

UND = "und"
MOST_LANGUAGES = 1000
#: Bound of the sample that is learned from: rows of each language, and characters in a row of each.
SAMPLE_ROWS, SAMPLE_CHARS = 600, 400
#: Hidden units of each direction.
HIDDEN = 12
#: Training: bytes of a window, windows of a step, steps, and the first rate.
WINDOW, BATCH, STEPS, RATE = 80, 96, 400, 0.02
#: Bytes of a stretch, bytes before and after it that only the state reads, and positions read at a time.
STRETCH, RUN_IN, CELLS = 960, 32, 1 << 20
#: Rows, and bytes of text, whose stretches are read side by side.
ROWS, ROW_BYTES = 4096, 4 << 20
LETTER = re.compile(r"[^\W\d_]")
PAD = 256


@dataclass
class Network:
    """Weights of each direction, with gates in the order update, reset, candidate: inputs x (3H, 257)
    and recurrence u (3H, H); output o (L, 2H + 1), the last column a constant."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def start(languages: list[str], rng: np.random.Generator) -> Network:
    h, n = HIDDEN, len(languages)
    w = {}
    for d in "fb":
        w[f"x{d}"] = rng.normal(0, 0.3, (3 * h, PAD + 1)).astype(np.float32)
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
    w["o"] = rng.normal(0, 0.1, (n, 2 * h + 1)).astype(np.float32)
    return Network(languages, w)


def order(d: str, steps: int) -> range:
    return range(steps) if d == "f" else range(steps - 1, -1, -1)


#: Slope of the gates, which are linear between 0 and 1 (a fraction of the cost of a sigmoid).
SLOPE = 0.2


def gate(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(SLOPE * x + 0.5, 0), 1)


def gate_slope(y: np.ndarray) -> np.ndarray:
    """Derivative of a gate of value y."""
    return SLOPE * ((y > 0) & (y < 1))


def taped(w: dict[str, np.ndarray], d: str, ids: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, H, rows) of one direction over ids (steps, rows), and what the gradient needs."""
    x, u, h = w[f"x{d}"], w[f"u{d}"], HIDDEN
    steps, rows = ids.shape
    out, tape = np.empty((steps, h, rows), x.dtype), []
    state = np.zeros((h, rows), x.dtype)
    for t in order(d, steps):
        gates, own = x[:, ids[t]], u @ state
        zr = gate(gates[: 2 * h] + own[: 2 * h])
        new = np.tanh(gates[2 * h :] + zr[h:] * own[2 * h :])
        tape.append((t, state, zr[:h], zr[h:], own[2 * h :], new))
        state = (new + zr[:h] * (state - new)) * live[t]
        out[t] = state
    return out, tape


def softmax(scores: np.ndarray) -> np.ndarray:
    """Probabilities along the last axis but one."""
    scores = np.exp(scores - scores.max(-2, keepdims=True))
    return scores / scores.sum(-2, keepdims=True)


def gradient(net: Network, ids: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the live positions (steps, rows), and its gradient through time."""
    w, h = net.weights, HIDDEN
    states, tapes = zip(*(taped(w, d, ids, live) for d in "fb"))
    p = softmax(w["o"][:, :h] @ states[0] + w["o"][:, h:-1] @ states[1] + w["o"][:, -1:])
    share, rows = live / live.sum(), np.arange(len(y))
    loss = -(np.log(p[:, y, rows] + 1e-12) * share).sum()
    p[:, y, rows] -= 1
    p *= share[:, None, :]
    g = {"o": np.zeros_like(w["o"])}
    g["o"][:, -1] = p.sum((0, 2))
    at = np.argsort(ids, axis=None, kind="stable")
    bytes_, first = np.unique(ids.ravel()[at], return_index=True)
    for i, d in enumerate("fb"):
        g["o"][:, i * h : (i + 1) * h] = np.einsum("tlr,thr->lh", p, states[i], optimize=True)
        out = w["o"][:, i * h : (i + 1) * h].T @ p
        u, gu, gates = w[f"u{d}"], np.zeros_like(w[f"u{d}"]), np.empty((len(ids), 3 * h, len(y)), p.dtype)
        back = np.zeros((h, len(y)), p.dtype)
        for t, state, z, r, own, new in reversed(tapes[i]):
            dh = (back + out[t]) * live[t]
            da = dh * (1 - z) * (1 - new * new)
            gates[t] = np.concatenate([dh * (state - new) * gate_slope(z), da * own * gate_slope(r), da])
            through = gates[t].copy()
            through[2 * h :] *= r
            gu += through @ state.T
            back = dh * z + u.T @ through
        flat = gates.transpose(0, 2, 1).reshape(-1, 3 * h)[at]
        g[f"x{d}"] = np.zeros_like(w[f"x{d}"])
        g[f"x{d}"][:, bytes_] = np.add.reduceat(flat, first, axis=0).T
        g[f"u{d}"] = gu
    return float(loss), g


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids (steps, rows), PAD past the end, and which positions are bytes, as numbers."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    live = np.arange(lengths.max()) < lengths[:, None]
    ids = np.full(live.shape, PAD, np.int64)
    ids[live] = np.frombuffer(b"".join(parts), np.uint8)
    return np.ascontiguousarray(ids.T), np.ascontiguousarray(live.T).astype(np.float32)


def as_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def train(rows: list[tuple[str, str]], seed: int = 5) -> Network:
    """A network learned from (text, language) rows by Adam steps on windows of them."""
    languages = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    net = start(languages, rng)
    texts = [(as_bytes(x), languages.index(y)) for x, y in sorted(rows)]
    by = [[x for x, y in texts if y == k and x] for k in range(len(languages))]
    by = [(k, xs) for k, xs in enumerate(by) if xs]
    if len(by) < 2:
        return net
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    each = BATCH // len(by) + 1  # languages in equal parts
    for step in range(1, STEPS + 1):
        parts, ys = [], []
        for k, xs in by:
            for i in rng.integers(len(xs), size=each):
                at = int(rng.integers(max(1, len(xs[i]) - WINDOW)))
                parts.append(xs[i][at : at + WINDOW])
                ys.append(k)
        _, g = gradient(net, *padded(parts), np.array(ys))
        rate = RATE * (1 - 0.95 * step / STEPS)
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.weights[k] = (net.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Labeller:
    """Document probabilities."""

    def __init__(self, net: Network) -> None:
        self.net = net
        # the gates' slope and middle go into the weights once
        scale, middle = (np.repeat(x, HIDDEN).astype(np.float32)[:, None] for x in ([SLOPE, SLOPE, 1], [0.5, 0.5, 0]))
        self.scaled = {k: w * scale + (middle if k[0] == "x" else 0) for k, w in net.weights.items() if k != "o"}

    def states(self, d: str, ids: np.ndarray, live: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place, states (H, rows)) in reading order; the array is used again for the next place."""
        x, u, h = self.scaled[f"x{d}"], self.scaled[f"u{d}"], HIDDEN
        steps, rows = ids.shape
        ends = ~live.all(1)
        state, gates, own = (np.zeros((n * h, rows), np.float32) for n in (1, 3, 3))
        zr, new = gates[: 2 * h], gates[2 * h :]
        for t in order(d, steps):
            np.take(x, ids[t], axis=1, out=gates, mode="clip")
            np.matmul(u, state, out=own)
            zr += own[: 2 * h]
            np.maximum(zr, 0, out=zr)
            np.minimum(zr, 1, out=zr)
            own[2 * h :] *= zr[h:]
            new += own[2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= zr[:h]
            state += new
            if ends[t]:
                state *= live[t]
            yield t, state

    def pooled(self, ids: np.ndarray, live: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Sums (rows, languages) of the probabilities of the positions that are a row's own."""
        o, h = self.net.weights["o"], HIDDEN
        scores = np.empty((len(ids), len(o), ids.shape[1]), np.float32)
        for t, state in self.states("f", ids, live):
            np.matmul(o[:, :h], state, out=scores[t])
        total = np.zeros(scores.shape[1:], np.float32)
        for t, state in self.states("b", ids, live):
            p = o[:, h:-1] @ state
            p += scores[t]
            p += o[:, -1:]
            p -= p.max(0)
            np.exp(p, out=p)
            p *= own[t] / p.sum(0)
            total += p
        return total.T

    def documents(self, texts: list[str | None]) -> np.ndarray:
        stretches: list[tuple[int, bytes, int, int]] = []  # text, bytes, and which of them are its own
        for i, text in enumerate(texts):
            data = as_bytes(text)
            for lo in range(0, len(data), STRETCH):
                hi, first = min(lo + STRETCH, len(data)), max(0, lo - RUN_IN)
                stretches.append((i, data[first : hi + RUN_IN], lo - first, hi - first))
        stretches.sort(key=lambda x: len(x[1]))
        out = np.zeros((len(texts), len(self.net.languages)))
        while stretches:
            part = stretches[-max(1, CELLS // len(stretches[-1][1])) :]
            del stretches[-len(part) :]
            ids, live = padded([x[1] for x in part])
            begin, end = (np.array([x[k] for x in part]) for k in (2, 3))
            at = np.arange(len(ids))[:, None]
            np.add.at(out, [x[0] for x in part], self.pooled(ids, live, ((at >= begin) & (at < end)).astype(np.float32)))
        total = out.sum(1, keepdims=True)
        return np.divide(out, total, out=out, where=total > 0)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def some_of(text: str, key: int) -> str:
    """At most SAMPLE_CHARS characters from anywhere in the text, by a generator of the row's own."""
    at = int(np.random.default_rng(key & (2**63 - 1)).integers(max(1, len(text) - SAMPLE_CHARS + 1)))
    return text[at : at + SAMPLE_CHARS]


def learned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", seed: int = 5) -> Network:
    """A network from a sample of SAMPLE_ROWS rows of each language and SAMPLE_CHARS characters of each.

    The rows of least keyed hash of doc_id and text, among all that have a language and are not held out, are
    taken; rows that are equal in both count as one. Rows are counted by language, and only the few thousand
    of lowest hashes are ranked; of a language whose rows are so much alike that too few are among these, all
    distinct ones are. The sample and the counts alone reach the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(lang).alias("y"), F.col(text).alias("x"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("u")
    )
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().limit(MOST_LANGUAGES + 1).collect()}  # one row for each language
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return train([], seed)
    # hashes are even, so three times the share that is needed holds enough rows, and few to rank
    shares = {y: 3 * SAMPLE_ROWS / n for y, n in counts.items()}
    low = reduce(or_, ((F.col("y") == y) & (F.col("u") <= (2**63 - 1 if s >= 1 else int(s * 2**64) - 2**63)) for y, s in shares.items()))

    def least(some: DataFrame) -> dict[str, tuple[int, int]]:
        """(greatest hash, count) of each language's distinct rows of least hash."""
        rank = F.row_number().over(Window.partitionBy("y").orderBy("u"))
        ranked = some.select("y", "u").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS)
        return {r["y"]: (r["most"], r["n"]) for r in ranked.groupBy("y").agg(F.max("u").alias("most"), F.count("u").alias("n")).collect()}

    limits = least(rows.where(low))
    alike = [y for y, s in shares.items() if s < 1 and limits.get(y, (0, 0))[1] < SAMPLE_ROWS]
    if alike:
        limits |= least(rows.where(F.col("y").isin(alike)))
    within = reduce(or_, ((F.col("y") == y) & (F.col("u") <= most) for y, (most, _) in limits.items()))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"y": p["y"], "u": p["u"], "x": [some_of(x, u) for x, u in zip(p["x"], p["u"])]})

    chosen = rows.where(within).mapInPandas(draw, "y string, u long, x string").dropDuplicates(["y", "u"])
    return train(sorted((r["x"], r["y"]) for r in chosen.collect()), seed)


def identify(docs: DataFrame, net: Network, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the language of each whole text and its probability. Nothing is shuffled; what the
    tasks receive is the network, whose size is fixed."""
    new = [lang, score]
    kept = [c for c in docs.columns if c not in new]
    schema = T.StructType([docs.schema[c] for c in kept]).add(lang, T.StringType(), False).add(score, T.DoubleType(), False)
    source, place = with_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        for batch in batches:
            for part in slices(batch, place, ROWS, ROW_BYTES):
                texts = part.column(place).to_pylist()
                some = [x if x and LETTER.search(x) else None for x in texts]
                p = labeller.documents(some) if net.languages else np.zeros((len(texts), 1))
                best = p.argmax(1)
                names = [net.languages[b] if x and net.languages else UND for x, b in zip(some, best)]
                top = np.where([n != UND for n in names], np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(names, pa.string()), pa.array(top, pa.float64())], names=[*kept, *new])

    return in_batches(source, run, schema)
