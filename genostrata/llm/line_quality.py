"""Quality of whole texts by a linear-chain conditional random field over their lines.

Each line is good or bad. What speaks for good are measures of the line itself and of the lines before
and after it, weighted; how labels follow each other has weights of its own. The weights are learned
here, in numpy, from a bounded sample of labelled documents whose lines all bear the document's label, by the
gradient of the conditional likelihood. A document's quality is the mean, weighted by length, of the
probabilities that forward and backward sums give its lines.

With two labels, the sums of one direction are one number a line, the log odds of good, so a text of any
number of lines is gone through in two passes that keep two numbers for each of its lines.

Defined results: lines end at line feeds and those without a word are left out; a text without a word,
an empty or a null one is one line without a character; a table without labelled rows that may be
learned from gives 0.5 for every row; of several labels of a document their mean counts, 0.5 as good; labels without a
document, and null ones, tell nothing; repeated rows each keep their row; input columns stay, except those
named as the output; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, with_text

#: Bound of the sample that is learned from: documents of each label, rows of each document, and lines
#: and characters of each row, which stand together in the text.
SAMPLE_DOCS, SAMPLE_COPIES, SAMPLE_LINES, SAMPLE_CHARS = 3000, 3, 200, 8000
#: Training: steps, rate, and what the squares of the weights cost.
STEPS, RATE, PENALTY = 250, 0.05, 1e-3
#: Rows, and bytes of text, that are measured at a time.
ROWS, ROW_BYTES = 2048, 2 << 20

SYMBOLS = "#*$%&|<>"
#: Classes of characters, as bits: small letter, capital, digit, symbol, end of a sentence, white space.
SMALL, CAPITAL, DIGIT, SYMBOL, STOP, SPACE = (1 << i for i in range(6))
CLASSES = 0x3000


def classes() -> np.ndarray:
    """The class of each character up to CLASSES; the last stands for all others, which count as small letters."""
    out = np.zeros(CLASSES + 1, np.uint8)
    for i in range(CLASSES):
        c = chr(i)
        if c.isalpha():
            out[i] = CAPITAL if c.isupper() else SMALL
        elif c.isdigit():
            out[i] = DIGIT
        elif c in SYMBOLS:
            out[i] = SYMBOL
        elif c in ".!?":
            out[i] = STOP
        elif c.isspace():
            out[i] = SPACE
    out[CLASSES] = SMALL
    return out


#: Measures of a line, each about between 0 and 1.
MEASURES = (
    "capitals", "mostly_capitals", "digits", "symbols", "many_symbols", "others", "stops", "ends_in_stop", "many_stops",
    "doubled", "many_doubled", "repeated", "many_repeated", "words", "few_words", "long_words", "short_words", "seen_before", "no_letter",
)
#: Weights of a line: its measures, those of its neighbours, whether it has neighbours, and a constant.
WIDTH = 3 * len(MEASURES) + 3


class Meter:
    """Measures the lines of texts."""

    def __init__(self) -> None:
        self.classes = classes()

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features of all lines, their lengths in characters, and the count of lines of each text)."""
        kept: list[str] = []
        counts, words = [], []
        for text in texts:
            seen: set[int] = set()
            before = len(kept)
            for line in (text or "").split("\n"):
                w = line.split()
                if w:
                    n = len(w)
                    key = hash(line)
                    words.append((n, sum(map(eq, w, islice(w, 1, None))), n - len(set(w)), sum(map(len, w)), key in seen))
                    seen.add(key)
                    kept.append(line)
            if len(kept) == before:
                kept.append("")
                words.append((0, 0, 0, 0, False))
            counts.append(len(kept) - before)
        number = np.array(counts)
        return self.features(kept, np.array(words, float).reshape(-1, 5), number), np.array([len(x) for x in kept]), number

    def features(self, lines: list[str], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        code = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.classes[np.minimum(code, CLASSES)]
        size = np.array([len(x) + 1 for x in lines])
        begin = np.cumsum(size) - size

        def count(kind: int) -> np.ndarray:
            return np.add.reduceat((kinds & kind).astype(bool), begin, dtype=np.int64) if len(lines) else np.zeros(0)

        small, capital, digit, symbol, stop = (count(k) for k in (SMALL, CAPITAL, DIGIT, SYMBOL, STOP))
        n, doubled, repeated, chars, seen = words.T
        letters, c, w = small + capital, np.maximum(chars, 1), np.maximum(n, 1)
        ends = np.array([x.rstrip()[-1:] in (".", "!", "?") for x in lines], float) * (n > 0)
        capitals, symbols, stops = capital / np.maximum(letters, 1), symbol / w, stop / w
        m = np.stack(
            [
                capitals, capitals > 0.5, digit / c, np.minimum(symbols, 1), symbols > 0.3, np.clip((c - letters - digit - symbol - stop) / c, 0, 1), np.minimum(stops, 1), ends, stops > 0.6,
                doubled / w, doubled > 0.3 * w, repeated / w, repeated > 0.6 * w, np.log1p(n) / 6, n < 4, np.minimum(chars / w / 20, 1), chars < 3 * w, seen, letters == 0,
            ], 1
        ).astype(float)
        first = np.zeros(len(lines), bool)
        first[np.cumsum(counts) - counts] = True
        last = np.roll(first, -1)
        up, down = np.roll(m, 1, 0) * ~first[:, None], np.roll(m, -1, 0) * ~last[:, None]
        return np.concatenate([m, up, down, ~first[:, None], ~last[:, None], np.ones((len(lines), 1))], 1)


@dataclass
class Field:
    """Weights of the measures for the log odds of good, and of labels that follow each other (from, to; bad 0, good 1)."""

    weights: np.ndarray
    steps: np.ndarray


def past(r: float, t: tuple[float, float, float, float]) -> float:
    """The log odds of good that those of a neighbour give: t has the weights of a step from bad to bad, bad to
    good, good to bad and good to good."""
    a, b = r + t[3], r + t[2]
    good = max(a, t[1]) + math.log1p(math.exp(-abs(a - t[1])))
    bad = max(b, t[0]) + math.log1p(math.exp(-abs(b - t[0])))
    return good - bad


def marginals(odds: list[float], field: Field) -> list[float]:
    """The probability that each line of a text is good, from each one's own log odds."""
    forth = tuple(field.steps.ravel().tolist())
    back = (forth[0], forth[2], forth[1], forth[3])
    told, out, r = [], [0.0] * len(odds), 0.0
    for i, e in enumerate(odds):
        told.append(past(r, forth) if i else 0.0)
        r = e + told[-1]
    r = 0.0
    for i in range(len(odds) - 1, -1, -1):
        own = odds[i] + (past(r, back) if i < len(odds) - 1 else 0.0)
        x = own + told[i]
        out[i] = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        r = own
    return out


def likelihood(x: np.ndarray, counts: np.ndarray, y: np.ndarray, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean conditional log likelihood of a line, and its gradient. Texts, sorted by falling length,
    are gone through side by side, line after line."""
    begin = np.cumsum(counts) - counts
    odds = np.stack([np.zeros(len(x)), x @ field.weights], 1)
    most = int(counts.max())
    alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    at = [begin[counts > t] + t for t in range(most)]
    alpha[at[0]] = odds[at[0]]
    for t in range(1, most):
        alpha[at[t]] = odds[at[t]] + np.logaddexp.reduce(alpha[at[t] - 1][:, :, None] + field.steps, 1)
    for t in range(most - 1, 0, -1):
        beta[at[t] - 1] = np.logaddexp.reduce(field.steps + (odds[at[t]] + beta[at[t]])[:, None, :], 2)
    z = np.logaddexp.reduce(alpha[begin + counts - 1], 1)
    all_z, label = np.repeat(z, counts), np.repeat(y, counts)
    p = np.exp(alpha[:, 1] + beta[:, 1] - all_z)
    inner = np.ones(len(x), bool)
    inner[begin] = False
    j = np.flatnonzero(inner)
    pair = np.exp(alpha[j - 1][:, :, None] + field.steps + (odds[j] + beta[j])[:, None, :] - all_z[j][:, None, None]).sum(0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y, y), counts - 1)
    value = (odds[np.arange(len(x)), label].sum() + (seen * field.steps).sum() - z.sum()) / len(x)
    return float(value), x.T @ (label - p) / len(x), (seen - pair) / len(x)


def train(sample: list[tuple[str, int]], steps: int = STEPS) -> Field:
    """Weights from (text, label) by steps of adaptive rates; without both labels only the constant is learned."""
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    if not sample:
        return field
    x, _, counts = Meter().lines([t for t, _ in sample])
    y = np.array([q for _, q in sample])
    order = np.argsort(-counts, kind="stable")
    begin = np.cumsum(counts) - counts
    x = x[np.concatenate([np.arange(begin[i], begin[i] + counts[i]) for i in order])]
    counts, y = counts[order], y[order]
    w = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        _, gw, gs = likelihood(x, counts, y, Field(w[:WIDTH], w[WIDTH:].reshape(2, 2)))
        g = np.concatenate([gw, gs.ravel()]) - 2 * PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + RATE * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Field(w[:WIDTH], w[WIDTH:].reshape(2, 2))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def window_of(text: str | None, key: int) -> str:
    """Lines that stand together, at most SAMPLE_LINES and SAMPLE_CHARS of them, from a place of the row's own."""
    lines = (text or "").split("\n")
    at = int(np.random.default_rng(key & (2**63 - 1)).integers(max(1, len(lines) - SAMPLE_LINES + 1)))
    return "\n".join(lines[at : at + SAMPLE_LINES])[:SAMPLE_CHARS]


def learned(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 11) -> Field:
    """A field from the labels that are not held out: of each label the SAMPLE_DOCS documents of least keyed
    hash. These ids, a bounded number, are joined with the documents; the bounded sample reaches the driver."""
    told = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull() & ~held_out(F.col(f"`{doc_id}`")))
    told = told.groupBy(F.col(f"`{doc_id}`").alias("_id")).agg((F.avg(F.col(f"`{label}`").cast("double")) >= 0.5).cast("int").alias("y"))
    told = told.withColumn("u", F.xxhash64(F.lit(seed), "_id"))
    chosen = None
    for y in (0, 1):
        one = told.where(F.col("y") == y).orderBy("u", "_id").limit(SAMPLE_DOCS)
        chosen = one if chosen is None else chosen.unionByName(one)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("x")).join(F.broadcast(chosen.select("_id", "y")), "_id")
    keyed = rows.select("_id", "y", F.xxhash64(F.lit(seed), "_id", "x").alias("u"), "x")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = [window_of(x, u) for x, u in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(short, pa.string())], names=["id", "y", "u", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType)]).add("y", T.IntegerType()).add("u", T.LongType()).add("x", T.StringType())
    short = in_batches(keyed, draw, schema)
    few = short.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("u"))).where(F.col("_n") <= SAMPLE_COPIES)
    return train(sorted((r["x"], r["y"]) for r in few.select("x", "y").collect()))


LINES = T.ArrayType(T.DoubleType(), False)


def judge(docs: DataFrame, field: Field, text: str = "text", score: str = "score", lines: str | None = None) -> DataFrame:
    """docs with the quality of each whole text, and if `lines` is named, the probability that it is good
    for each of its lines that has a word. Nothing is shuffled; what the tasks receive is the field."""
    new = [c for c in (score, lines) if c]
    kept = [c for c in docs.columns if c not in new]
    schema = T.StructType([docs.schema[c] for c in kept]).add(score, T.DoubleType(), False)
    if lines:
        schema.add(lines, LINES, False)
    source, place = with_text(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter()
        for batch in batches:
            for part in slices(batch, place, ROWS, ROW_BYTES):
                x, size, counts = meter.lines(part.column(place).to_pylist())
                odds, at, found, each = (x @ field.weights).tolist(), 0, [], []
                weight = np.maximum(size, 1)
                for n in counts.tolist():
                    p = marginals(odds[at : at + n], field)
                    w = weight[at : at + n]
                    found.append(min(1.0, max(0.0, float(np.dot(p, w) / w.sum()))))
                    each.append(p)
                    at += n
                columns = [*part.columns[: len(kept)], pa.array(found, pa.float64())]
                if lines:
                    columns.append(pa.array(each, pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return in_batches(source, run, schema)
