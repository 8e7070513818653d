"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a random direction; a vector is in it if its score exceeds a threshold, that is, if it
lies in the direction's cap. Directions are all concatenations of one code word for each block of
coordinates (after a random rotation), so a vector finds its filters by list decoding: block by
block, keeping the beginnings that can still reach the threshold. Vectors that share a filter are
compared exactly, in double precision, however many they are. A filter gives spanning forests of
the links within it; the connected components of these are the components, and within each all pairs are then compared
once, block by block, to count the links. No list of all pairs ever exists.

The threshold and the number of directions follow from the number of vectors: about BUCKET vectors
in a filter, and SHARED filters expected to hold both of a pair at the least similarity, spread over
CODES codes, each with a rotation and code words of its own, as filters of one code hold or miss a
pair together.

Defined results: equal vectors are one class, and copies link with each other; a null, empty or
zero vector, or one with a null or non-finite component, links with nothing; vectors of different
lengths don't link; a pair at the threshold exactly links; repeated rows each keep their row; an
empty table gives an empty table; the result has the columns named, whatever else the input has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, in_batches, lowest, runs_of, told

COSINE = 0.9
SHARED, BUCKET, CODES = 20.0, 48, 4
#: Code words of a block at most; more directions take more blocks.
MOST_WORDS = 1024
#: A filter of more classes is compared as tiles, one for each pair of its parts of about so many.
PART = 4096
BLOCK = 512


def tail(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(np.asarray(x) / math.sqrt(2))


def plan(n: int, cosine: float = COSINE) -> tuple[float, int, int]:
    """(threshold in standard deviations, blocks, code words of a block) of each code for n vectors."""
    p = min(0.02, BUCKET / max(n, 1))
    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > p else (lo, mid)
    t = lo
    x = np.linspace(t, t + 8, 4001)
    both = np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * tail((t - cosine * x) / math.sqrt(1 - cosine**2)), x)
    directions = SHARED / CODES / both
    blocks = max(2, math.ceil(math.log(directions) / math.log(MOST_WORDS)))
    return t, blocks, math.ceil(directions ** (1 / blocks))


class Caps:
    """Product code for vectors of length d."""

    def __init__(self, d: int, t: float, blocks: int, words: int, code: int, seed: int = 23) -> None:
        rng = np.random.default_rng([seed, d, code])
        self.t = t
        self.turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        self.bounds = [d * i // blocks for i in range(blocks + 1)]
        self.codes = []
        for lo, hi in zip(self.bounds, self.bounds[1:]):
            g = rng.normal(size=(hi - lo, words))
            # each block's score has its share of a unit variance over random directions
            self.codes.append(g / np.maximum(np.linalg.norm(g, axis=0), 1e-12) * math.sqrt(hi - lo))

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters that hold each row of unit vectors."""
        x = x @ self.turn
        scores = [x[:, lo:hi] @ g for lo, hi, g in zip(self.bounds, self.bounds[1:], self.codes)]
        best = np.stack([s.max(1) for s in scores], 1)
        rest = np.cumsum(best[:, ::-1], 1)[:, ::-1]
        out = []
        for i in range(len(x)):
            s, code = np.zeros(1), np.zeros(1, np.int64)
            for k, block in enumerate(scores):
                left = rest[i, k + 1] if k + 1 < len(scores) else 0.0
                a, b = np.nonzero(s[:, None] + block[i] >= self.t - left)
                s, code = s[a] + block[i, b], code[a] * block.shape[1] + b
            out.append(code)
        return out


def arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    """The usable vectors of a column; None for those that link with nothing."""
    out = []
    flat, offsets, valid = column.values, column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    holes = flat.is_null().to_numpy(zero_copy_only=False)
    v = flat.to_numpy(zero_copy_only=False)
    for ok, lo, hi in zip(valid, offsets, offsets[1:]):
        x = v[lo:hi]
        out.append(x if ok and hi > lo and not holes[lo:hi].any() and np.isfinite(x).all() and x.any() else None)
    return out


def units(vectors: list[np.ndarray]) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def marked(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, c, x): each row with its class, null if it links with nothing, and its vector as bytes."""
    kind = vectors.schema[embedding].dataType.elementType.typeName()
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>" if kind != "float" else "array<float>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [None if v is None else (v + 0).astype(np.float64 if kind != "float" else np.float32).tobytes() for v in arrays(b.column("x"))]  # + 0: one zero
            cs = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in data]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cs, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "c", "x"])

    return in_batches(source, run, "vec_id long, c binary, x binary")


def filtered(classes: DataFrame, dtype: type, t: float, blocks: int, words: int) -> DataFrame:
    """(path, c, x): each class once for each filter that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caps: dict[int, list[Caps]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                x = [np.frombuffer(v, dtype) for v in b.column("x").to_pylist()]
                for d in sorted({len(v) for v in x}):
                    if d not in caps:
                        caps[d] = [Caps(d, t, min(blocks, d), words, k) for k in range(CODES)]
                    rows = np.array([i for i, v in enumerate(x) if len(v) == d])
                    u = units([x[i] for i in rows])
                    for k, code in enumerate(caps[d]):
                        got = code.filters(u)
                        take = pa.array(np.repeat(rows, [len(g) for g in got]))
                        path = np.concatenate(got) * CODES + k ^ (np.int64(d) << np.int64(44))
                        yield pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), b.column("c").take(take), b.column("x").take(take)], names=["path", "c", "x"])

    return in_batches(classes.select("c", "x"), run, "path long, c binary, x binary")


def alone(x: np.ndarray, cosine: float, step: int = 512) -> np.ndarray:
    """Which unit vectors have no other within the threshold, with a margin for rounding."""
    out = np.ones(len(x), bool)
    for lo in range(0, len(x), step):
        near = x[lo : lo + step] @ x.T >= cosine - 1e-9
        near[np.arange(len(near)), lo + np.arange(len(near))] = False
        out[lo : lo + step] = ~near.any(1)
    return out


def forest(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector the first one that it is connected to by links; each found member is
    compared with what is not yet reached."""
    root = np.arange(len(x))
    todo = np.flatnonzero(~alone(x, cosine))
    while len(todo):
        first = todo[0]
        todo, queue = todo[1:], [first]
        while queue and len(todo):
            near = x[todo] @ x[queue.pop()] >= cosine
            root[todo[near]] = first
            queue += todo[near].tolist()
            todo = todo[~near]
    return root


def filter_links(rows: DataFrame, dtype: type, cosine: float) -> DataFrame:
    """(a, b): links that connect what is linked within each filter, a spanning forest of each tile:
    a very large filter is cut into parts, and every pair of parts is compared in one place."""
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m >= 2")
    rows = rows.join(counts, "path")
    parts = F.ceil(F.col("m") / PART)
    part = F.when(F.col("m") > PART, F.pmod(F.xxhash64("c"), parts)).otherwise(F.lit(0).cast("bigint"))
    # of several parts, the tiles of two hold all pairs within a part too
    others = F.when(F.col("m") > PART, F.filter(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda i: i != F.col("part"))).otherwise(F.array(F.col("part")))
    cut = rows.withColumn("part", part).withColumn("other", F.explode(others)).select(
        F.xxhash64("path", F.least("part", "other"), F.greatest("part", "other")).alias("leaf"), "c", "x"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs_of(batches, "leaf"):
            c = t.column("c").combine_chunks()
            vs = [np.frombuffer(v, dtype) for v in t.column("x").to_pylist()]
            ends = np.append(bounds[1:], t.num_rows)
            a, b = [], []
            for lo, hi in zip(bounds, ends):
                if hi - lo > 1 and len({len(v) for v in vs[lo:hi]}) == 1:
                    root = lowest(forest(units(vs[lo:hi]), cosine))
                    at = np.flatnonzero(root != np.arange(hi - lo))
                    a.append(at + lo)
                    b.append(root[at] + lo)
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.concatenate(a))), c.take(pa.array(np.concatenate(b)))], names=["a", "b"])

    return in_batches(cut.repartition("leaf").sortWithinPartitions("leaf", "c"), run, "a binary, b binary").distinct()


def counted_links(grouped: DataFrame, dtype: type, cosine: float) -> DataFrame:
    """(c, links) of rows (component, c, times, x): how many rows each class links with, every pair
    of blocks of a component in one place."""
    size = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK)
    rows = grouped.join(size, "component").withColumn("block", F.pmod(F.xxhash64("c"), blocks))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "c", "block", "times", "x"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in runs_of(batches, "tile"):
            c = t.column("c").combine_chunks()
            block, times = t.column("block").to_numpy(), t.column("times").to_numpy()
            vs = [np.frombuffer(v, dtype) for v in t.column("x").to_pylist()]
            ends = np.append(bounds[1:], t.num_rows)
            at, links = [], []
            for lo, hi in zip(bounds, ends):
                if hi - lo < 2:
                    continue
                x = units(vs[lo:hi])
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                b = block[lo:hi]
                if (b != b[0]).any():
                    near &= b[:, None] != b  # pairs within a block have a tile of their own
                at.append(np.arange(lo, hi))
                links.append(near @ times[lo:hi])
            if at:
                yield pa.RecordBatch.from_arrays([c.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(links), pa.int64())], names=["c", "links"])

    return in_batches(rows.repartition("tile").sortWithinPartitions("tile"), run, "c binary, links long").groupBy("c").agg(F.sum("links").alias("links"))


def dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    dtype = np.float32 if vectors.schema[embedding].dataType.elementType.typeName() == "float" else np.float64
    m = durable(marked(vectors, vec_id, embedding))
    classes = durable(m.where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"), F.first("x").alias("x")))
    t, blocks, words = plan(classes.count(), cosine)
    edges = filter_links(filtered(classes, dtype, t, blocks, words), dtype, cosine)
    ends = durable(components(edges))
    grouped = ends.join(classes, ends["vertex"] == classes["c"]).select("component", "c", "times", "least", "x")
    links = counted_links(grouped.drop("least"), dtype, cosine)
    ids = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = grouped.select("component", "c").join(ids, "component").join(links, "c", "left").select("c", "component_id", "links")
    result = classes.select("c", "times", "least").join(linked, "c", "left").select(
        "c", "times", F.coalesce("component_id", "least").alias("component_id"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return (
        told(m.select("vec_id", "c"), durable(result.where("n_links > 0")), "c")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
