"""Modes of several numbers of clusters as a graph: which columns go together, how far modes lie
apart, and one order of the columns for all.

Modes are few, so what comes to the driver is a K by K matrix of products for each two of them, from
one pass over (mode, sample_id, k, q); memberships stay in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align


@dataclass
class Products:
    """Sums over samples of products of columns, by pair of modes, and the numbers of columns."""

    of: dict[tuple[str, str], np.ndarray]
    ks: dict[str, int]
    n: int

    def between(self, a: str, b: str) -> np.ndarray:
        return self.of[a, b] if (a, b) in self.of else self.of[b, a].T

    def distances(self, q: str, p: str) -> np.ndarray:
        """Mean squared distance of each column of q from each of p."""
        sq, sp = np.diag(self.between(q, q)), np.diag(self.between(p, p))
        return (sq[:, None] + sp - 2 * self.between(q, p)) / self.n


@dataclass(frozen=True)
class Link:
    """The columns of the mode `high` and those of `low` that they go to, `low` having no more."""

    low: str
    high: str
    targets: tuple[int, ...]
    objective: float
    cost: float


def products(modes: DataFrame) -> Products:
    c = align.columns_of(modes.withColumnRenamed("mode", "run_id"))
    return Products({(i, j): c.gram[c.place(i), c.place(j)] for i in c.ids for j in c.ids if i <= j}, c.ks, c.n)


def link(x: Products, low: str, high: str) -> Link:
    """Where each column of `high` goes: with one column more, two of them are merged; else the nearest
    match in which each column of `low` is used."""
    d = x.distances(high, low)
    if x.ks[high] == x.ks[low] + 1:
        objective, _, to = align.merged_matching(x.between(high, high), x.between(high, low), np.diag(x.between(low, low)), x.n)
    else:
        to = [int(t) for t in align.matching(d)]
        objective = float(d[np.arange(len(to)), to].sum())
    m = np.zeros((len(to), x.ks[low]))
    m[np.arange(len(to)), to] = 1
    rest = np.trace(x.between(low, low)) - 2 * (m * x.between(high, low)).sum() + np.trace(m.T @ x.between(high, high) @ m)
    return Link(low, high, tuple(to), objective, max(0.0, float(rest)) / (2 * x.n))


def graph(x: Products) -> tuple[list[Link], list[Link]]:
    """(links, anchors): links of every two modes of one K and of neighbouring K, and for each step in K
    the link of least objective, from the lowest step on; the first among equals by names."""
    levels = [sorted((m for m in x.ks if x.ks[m] == k), key=natural) for k in sorted(set(x.ks.values()))]
    inside = [link(x, a, b) for level in levels for a in level for b in level if a != b]
    steps = [[link(x, a, b) for b in high for a in low] for low, high in zip(levels, levels[1:])]
    return inside + [one for step in steps for one in step], [min(step, key=lambda one: round(one.objective, 12)) for step in steps]


def natural(name: str) -> tuple[int, str]:
    return len(name), name


def kept_apart(to: Link, x: Products) -> list[int]:
    """A place of its own for each column of the higher mode: of those that go to one column the nearest
    takes its place, and the others new places at the end, in their order."""
    d = x.distances(to.high, to.low)
    nearest = {t: min((i for i, s in enumerate(to.targets) if s == t), key=lambda i: (d[i, t], i)) for t in set(to.targets)}
    out, end = [], x.ks[to.low]
    for i, t in enumerate(to.targets):
        if nearest[t] == i:
            out.append(t)
        else:
            out.append(end)
            end += 1
    return out


def orders(x: Products) -> dict[str, list[int]]:
    """For each mode the place of each of its columns, so that columns that go together have one place.

    The lower mode of the first anchor keeps its order; a level's anchored mode follows the anchored
    mode of the level below, and the level's others follow it."""
    links, anchors = graph(x)
    by = {(one.low, one.high): one for one in links}
    levels = [sorted((m for m in x.ks if x.ks[m] == k), key=natural) for k in sorted(set(x.ks.values()))]
    first = anchors[0].low if anchors else levels[0][0]
    out = {first: list(range(x.ks[first]))}
    heads = [first, *(a.high for a in anchors)]
    for level, head, anchor in zip(levels, heads, [None, *anchors]):
        if anchor is not None:
            below = out[anchor.low]
            out[head] = [below[t] if t < x.ks[anchor.low] else t for t in kept_apart(anchor, x)]
        for other in level:
            if other not in out:
                out[other] = [out[head][t] for t in kept_apart(by[head, other], x)]
    return out


def reordered(modes: DataFrame, places: dict[str, list[int]]) -> DataFrame:
    """(mode, sample_id, k, q) with each mode's columns in their places."""
    rows = [(m, k, p) for m, to in places.items() for k, p in enumerate(to)]
    moves = modes.sparkSession.createDataFrame(rows, "mode string, k int, place int")  # a row for each column of each mode
    return modes.join(F.broadcast(moves), ["mode", "k"]).select("mode", "sample_id", F.col("place").alias("k"), "q")


def table(modes: DataFrame) -> DataFrame:
    """(low, high, cost, anchor) of the links."""
    links, anchors = graph(products(modes))
    rows = [(one.low, one.high, one.cost, one in anchors) for one in links]
    return modes.sparkSession.createDataFrame(rows, "low string, high string, cost double, anchor boolean")


def of_runs(runs: DataFrame, test: bool = True, mean: bool = False) -> tuple[list[dict], Products, DataFrame]:
    """The modes of runs of several K, the products of their columns, and the modes' rows with the columns that go
    together in one place: representatives, or means of the runs of each."""
    found = align.modes(runs, test)
    rows = align.mode_rows(runs, found, mean).persist()
    x = products(rows)
    return found, x, reordered(rows, orders(x))
