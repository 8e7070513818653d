"""Product codes of vectors: a codebook for each part of the vectors, by exact k-means in integers.

Rows are read into blocks. For each part a block keeps a metric tree over its rows: anchors that
steal the points nearer to them make about a square root of a ball's points into groups, each group
is split again in the same way until it is a leaf, and the groups are put together again, the pair
of least enclosing ball first, so that the tree grows from its middle both ways. Every ball holds the
sum and the number of its points.

In a round the entries of the codebook go down each tree. A ball takes over the entries that its
parent left and drops those that are further from each of its points than another one is; where one
is left the whole ball is its own and gives the sums it holds, and in a leaf points are compared with
what is left. Bounds are drawn with room for rounding and distances are integers, so every round is
what comparing all points with all entries gives. Blocks are written once to the shared folder. A
task gives its sums once, a few numbers for each entry, and Spark adds them; the driver sees the
codebooks and their sums alone.

Defined results: rows whose vector is null or holds a null or a number that isn't finite are left
out; shorter vectors count as filled up with zeros to the longest one, and all to a multiple of the
parts; components of any size are exact integers, and an error that no long holds is null; the first
entries are the rows of least id, null ids last, equal ids by their vectors; with fewer rows there are
fewer entries; repeated rows each keep their row; other columns stay, but for those named as the
output; an empty table gives an empty table and empty codebooks.
"""

from __future__ import annotations

import io
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, in_batches

#: Components are whole numbers of this part of one.
SCALE = 4096
#: Rows of a block, and points of a ball that is not split further.
BLOCK, LEAF = 4096, 96
#: Room for rounding in the bounds of a ball, relative to the distances.
ROOM = 1e-9
#: Sums leave a task in digits of this many bits.
DIGIT = 32


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): as int64 if all are small, else as Python's integers."""
    if not x.size or np.abs(x).max() < 2.0**40:
        return np.floor(x * SCALE).astype(np.int64)
    big = [math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = big
    return out.reshape(x.shape)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (points, entries): in doubles where these hold them, else in Python's integers."""
    most = max(largest(x), largest(entries))
    kind = float if 4 * most * most * max(1, x.shape[1]) < 1 << 53 else object
    d = x.astype(kind)[:, None, :] - entries.astype(kind)[None]
    return (d * d).sum(2)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    most = max(largest(a), largest(b))
    kind = np.int64 if 4 * most * most * max(1, a.shape[1]) < 1 << 62 else object
    d = a.astype(kind) - b.astype(kind)
    return (d * d).sum(1)


@dataclass
class Tree:
    """Balls in arrays, the root last; points of a ball are order[begin:end]. left is -1 for a leaf."""

    order: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    left: np.ndarray
    right: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    total: np.ndarray


def anchored(x: np.ndarray, count: int) -> list[np.ndarray]:
    """Groups of points by anchors: the next anchor is the point furthest from its own, in the widest
    group, and takes the points that are nearer to it. A group's points nearer to their anchor than
    half the way to the new one are not looked at."""
    anchors, owner = [0], np.zeros(len(x), np.int64)
    dist = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(anchors) < count:
        new = int(dist.argmax())
        if dist[new] <= 0:
            break
        apart = np.sqrt(((x[anchors] - x[new]) ** 2).sum(1))
        near = np.flatnonzero(dist > apart[owner] / 2)
        to_new = np.sqrt(((x[near] - x[new]) ** 2).sum(1))
        taken = to_new < dist[near]
        owner[near[taken]], dist[near[taken]] = len(anchors), to_new[taken]
        anchors.append(new)
    by_owner = np.argsort(owner, kind="stable")
    return [g for g in np.split(by_owner, np.searchsorted(owner[by_owner], np.arange(1, len(anchors)))) if len(g)]


def agglomerated(x: np.ndarray, groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of nodes to put together, each a new node after the groups and the pairs before it: always
    those of the least ball around both."""
    k = len(groups)
    mean = np.array([x[g].mean(0) for g in groups])
    size = np.array([len(g) for g in groups], float)
    radius = np.array([np.sqrt(((x[g] - m) ** 2).sum(1).max()) for g, m in zip(groups, mean)])
    name = list(range(k))
    around = np.full((k, k), np.inf)

    def measure(i: int, live: np.ndarray) -> None:
        apart = np.sqrt(((mean[live] - mean[i]) ** 2).sum(1))
        r = np.maximum((apart + radius[live] + radius[i]) / 2, np.maximum(radius[live], radius[i]))
        around[i, live] = around[live, i] = r
        around[i, i] = np.inf

    live = np.ones(k, bool)
    for i in range(k):
        measure(i, np.flatnonzero(live))
    out = []
    for made in range(k, 2 * k - 1):
        i, j = divmod(int(around.argmin()), k)
        out.append((name[i], name[j]))
        mean[i] = (mean[i] * size[i] + mean[j] * size[j]) / (size[i] + size[j])
        size[i], radius[i], name[i] = size[i] + size[j], around[i, j], made
        live[j] = False
        around[j], around[:, j] = np.inf, np.inf
        measure(i, np.flatnonzero(live))
    return out


def tree_of(points: np.ndarray) -> Tree | None:
    """The metric tree of points whose squared distances doubles hold exactly; else none is made."""
    n, width = points.shape
    most = largest(points)
    if points.dtype == object or not n or 4 * most * most * max(1, width) >= 1 << 53:
        return None
    x = points.astype(float)
    left, right, own = [], [], []

    def ball(children: tuple[int, int], points_of: np.ndarray | None) -> int:
        left.append(children[0])
        right.append(children[1])
        own.append(points_of)
        return len(left) - 1

    def grown(at: np.ndarray) -> int:
        if len(at) <= LEAF or (x[at] == x[at[0]]).all():
            return ball((-1, -1), at)
        groups = anchored(x[at], max(2, round(math.sqrt(len(at)))))
        nodes = [grown(at[g]) for g in groups]
        for i, j in agglomerated(x[at], groups):
            nodes.append(ball((nodes[i], nodes[j]), None))
        return nodes[-1]

    root = grown(np.arange(n))
    balls = len(left)
    begin, end, order, at = np.zeros(balls, np.int64), np.zeros(balls, np.int64), [], 0
    stack = [(root, False)]
    while stack:
        i, done = stack.pop()
        if done:
            begin[i], end[i] = begin[left[i]], end[right[i]]
        elif left[i] < 0:
            begin[i], end[i] = at, at + len(own[i])
            order.append(own[i])
            at = end[i]
        else:
            stack += [(i, True), (right[i], False), (left[i], False)]
    order = np.concatenate(order)
    x = x[order]
    pivot, radius, total = np.zeros((balls, width)), np.zeros(balls), np.zeros((balls, width), np.int64)
    for i in range(balls):
        part = x[begin[i] : end[i]]
        s = part.sum(0)
        same = (part == part[0]).all()
        total[i], pivot[i] = s.astype(np.int64), part[0] if same else s / len(part)
        radius[i] = 0.0 if same else math.sqrt(((part - pivot[i]) ** 2).sum(1).max()) * (1 + ROOM)
    return Tree(order.astype(np.int32), pivot, radius, np.array(left), np.array(right), begin, end, total)


def assigned(points: np.ndarray, tree: Tree | None, entries: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, int]]]:
    """The nearest entry of each point, the first of equal ones, and (entry, sum, count) of the balls and
    points that make them up."""
    n, k = len(points), len(entries)
    owner = np.zeros(n, np.int64)
    gains: list[tuple[int, np.ndarray, int]] = []
    if tree is None or 4 * largest(entries) ** 2 * max(1, points.shape[1]) >= 1 << 53:
        if n:
            owner = distances(points, entries).argmin(1).astype(np.int64)
        gains += [(e, points[owner == e].sum(0), int((owner == e).sum())) for e in range(k) if n and (owner == e).any()]
        return owner, gains
    c = entries.astype(float)
    apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    fresh = ~np.triu(apart == 0, 1).any(0)  # of equal entries the first alone is asked
    balls, asked = np.array([len(tree.left) - 1]), fresh[None].copy()
    loose: list[np.ndarray] = []
    left_of: list[np.ndarray] = []
    while len(balls):
        d = np.where(asked, ((tree.pivot[balls][:, None] - c[None]) ** 2).sum(2), np.inf)
        best = d.argmin(1)
        least, r = d[np.arange(len(balls)), best], tree.radius[balls]
        bound = 2 * r[:, None] * apart[best]
        with np.errstate(invalid="ignore"):
            asked &= ~(d - least[:, None] > bound + ROOM * (d + least[:, None]))
        one_point = r == 0
        asked[one_point] = np.arange(k) == best[one_point, None]
        owned = asked.sum(1) == 1
        for i, e in zip(balls[owned], best[owned]):
            owner[tree.order[tree.begin[i] : tree.end[i]]] = e
            gains.append((int(e), tree.total[i], int(tree.end[i] - tree.begin[i])))
        rest = ~owned
        leaf = tree.left[balls] < 0
        for i, a in zip(balls[rest & leaf], asked[rest & leaf]):
            loose.append(tree.order[tree.begin[i] : tree.end[i]])
            left_of.append(np.broadcast_to(a, (len(loose[-1]), k)))
        down = rest & ~leaf
        balls, asked = np.concatenate([tree.left[balls[down]], tree.right[balls[down]]]), np.concatenate([asked[down], asked[down]])
    if loose:
        at, allowed = np.concatenate(loose), np.concatenate(left_of)
        x = points[at].astype(float)
        owner[at] = np.where(allowed, ((x[:, None] - c[None]) ** 2).sum(2), np.inf).argmin(1)
        for e in np.unique(owner[at]):
            own = at[owner[at] == e]
            gains.append((int(e), points[own].sum(0), len(own)))
    return owner, gains


@dataclass
class Codebooks:
    """entries[part][entry] as integers of 1 / SCALE."""

    entries: list[np.ndarray]

    def written(self) -> str:
        """All components by part, entry and place."""
        return ",".join(str(int(v)) for part in self.entries for e in part for v in e)


def kept_rows(vectors: DataFrame, vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    x = F.col(f"`{vector}`").cast("array<double>")
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def parts_of(lists: pa.Array, width: int, parts: int) -> np.ndarray:
    """(rows, parts, width of a part) of vectors, filled up with zeros."""
    n = len(lists)
    long = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    x = np.zeros((n, width))
    x[np.repeat(np.arange(n), long), np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)] = lists.flatten().to_numpy(zero_copy_only=False)
    return whole(x).reshape(n, parts, width // parts)


def to_blocks(rows: DataFrame, kept: list[str], vector: str, width: int, parts: int) -> DataFrame:
    """Blocks of rows: the kept columns as an Arrow stream, the integers, and a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                x = parts_of(b.column(len(kept)), width, parts)
                sink = io.BytesIO()
                columns = pa.RecordBatch.from_arrays(b.columns[: len(kept)], names=[str(i) for i in range(len(kept))])
                with pa.ipc.new_stream(sink, columns.schema) as w:
                    w.write_batch(columns)
                trees = [tree_of(x[:, p]) for p in range(parts)]
                small = x.astype(np.int32) if x.dtype != object and largest(x) < 1 << 31 else x
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue()]), pa.array([pickle.dumps((small, trees))])], names=["rows", "trees"])

    columns = [F.col(f"`{c}`") for c in kept]
    return durable(in_batches(rows.select(*columns, F.col(f"`{vector}`").cast("array<double>").alias("__x")), run, "rows binary, trees binary"))


def opened(raw: bytes) -> tuple[np.ndarray, list[Tree | None]]:
    x, trees = pickle.loads(raw)
    return x.astype(np.int64) if x.dtype != object else x, trees


def round_of(blocks: DataFrame, books: Codebooks) -> Codebooks:
    """The next codebooks: each entry the floor of the mean of what is nearest to it, or as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                x, trees = opened(raw)
                for p, (tree, entries) in enumerate(zip(trees, books.entries)):
                    for e, s, n in assigned(x[:, p], tree, entries)[1]:
                        old = sums.setdefault((p, e), [0] * (len(s) + 1))
                        for i, v in enumerate([n, *s.tolist()]):
                            old[i] += v
        out: list[tuple[int, int, int, int, int]] = []
        for (p, e), s in sums.items():
            for i, v in enumerate(s):
                sign, v = (-1 if v < 0 else 1), abs(v)
                digit = 0
                while v or not digit:
                    out.append((p, e, i, digit, sign * (v & ((1 << DIGIT) - 1))))
                    v, digit = v >> DIGIT, digit + 1
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "place", "digit", "value"])

    sums = in_batches(blocks.select("trees"), run, "part long, entry long, place long, digit long, value long")
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect():  # a few for each number of the codebooks
        one = found.setdefault((r["part"], r["entry"]), {})
        one[r["place"]] = one.get(r["place"], 0) + (r["value"] << (DIGIT * r["digit"]))
    new = [e.astype(object) for e in books.entries]
    for (p, e), one in found.items():
        for i in range(new[p].shape[1]):
            new[p][e, i] = one[i + 1] // one[0]
    return Codebooks([fitted(e) for e in new])


def fitted(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if largest(x) < 1 << 60 else x


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, code: str = "code", error: str = "error"
) -> tuple[DataFrame, Codebooks]:
    """vectors, the vector left out, with the code of each (the numbers of its entries) and the squared
    distance to what the code stands for, in units of 1 / SCALE squared; and the codebooks."""
    kept = [c for c in vectors.columns if c not in (vector, code, error)]
    rows = vectors.where(kept_rows(vectors, vector))
    x = F.col(f"`{vector}`").cast("array<double>")
    longest = rows.agg(F.max(F.size(x))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = rows.select(F.col(f"`{vec_id}`").alias("i"), x.alias("x")).orderBy(F.col("i").asc_nulls_last(), "x").limit(entries).collect()
    start = parts_of(pa.array([r["x"] for r in first], pa.list_(pa.float64())), width, parts)
    books = Codebooks([fitted(start[:, p].astype(object)) for p in range(parts)])
    blocks = to_blocks(rows, kept, vector, width, parts)
    for _ in range(rounds if first else 0):
        books = round_of(blocks, books)

    schema = T.StructType([vectors.schema[c] for c in kept]).add(code, T.ArrayType(T.IntegerType(), False), False).add(error, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns = pa.ipc.open_stream(data).read_next_batch()
                points, trees = opened(raw)
                codes, total = np.zeros((len(points), parts), np.int32), np.zeros(len(points), object)
                for p, (tree, book) in enumerate(zip(trees, books.entries)):
                    codes[:, p] = assigned(points[:, p], tree, book)[0]
                    total = total + apart(points[:, p], book[codes[:, p]])
                errors = pa.array([int(v) if v < 1 << 63 else None for v in total], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns.columns, pa.array(codes.tolist(), pa.list_(pa.int32())), errors], names=[*kept, code, error])

    return in_batches(blocks, run, schema), books
