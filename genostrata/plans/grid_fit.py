"""Fits of the admixture model on a grid of tiles: SVD and ALS starts, EM, adaptive EM, quasi-Newton
block updates, projection, supervised fits, cross-validation, several starts and sweeps.

P stays with its blocks and Q with its chunks of samples, both on the executors; a batch of fits, as the
folds of a cross-validation or several starts are, goes through the same passes over the genotypes. The
driver holds a few numbers for each member of the batch and matrices of K by K.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import kernels as kn
from ..functions.expr import EPS, MISSING
from ..operators.align import column_order
from ..operators.folds import STEP, mixed
from ..sources.paths import exists
from ..sources.sinks import write_cv, write_fit
from .fit import Options
from .grid import FAN, SUMS, At, Grid, P, Q, layers, rows_of, state_rows


@dataclass
class Fit:
    """The state of a batch of fits, one layer of P and of Q, with the likelihood of each and its course."""

    state: DataFrame
    k: int
    log_likelihood: list[float]
    course: list[list[float]] = field(default_factory=list)

    @property
    def members(self) -> int:
        return len(self.log_likelihood)


def q_rows(grid: Grid, f: Fit) -> DataFrame:
    """(b, sample_id, q)."""
    return grid.arrays(f.state, Q, f.k, "q", "sample_id")


def p_rows(grid: Grid, f: Fit) -> DataFrame:
    """(b, variant_id, p)."""
    return grid.arrays(f.state, P, f.k, "p", "variant_id")


def snapped(q: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """Labelled rows at their population."""
    if y is None:
        return q
    q = q.copy()
    known = np.flatnonzero(y >= 0)
    q[known] = EPS / (q.shape[1] - 1)
    q[known, y[known]] = 1 - EPS
    return q


def likelihoods(grid: Grid, state: DataFrame, k: int, members: int) -> list[float]:
    got = grid.numbers(grid.step(state, k, lambda g, p, q, at: (None, None, [kn.log_likelihood(g, p[0], q[0])]), [0], [0]))
    return [float(got[b, 0][0]) for b in range(members)]


def whole_rows(rows: DataFrame, index: str, n: int, what: str) -> DataFrame:
    """rows, if there is one for each index from 0 to n - 1, or an error with both counts."""
    got = rows.agg(F.count(index), F.count_distinct(index), F.min(index), F.max(index)).first()
    if tuple(got) != (n, n, 0, n - 1):
        raise ValueError(f"{what}: {got[0]} rows, {got[1]} distinct from {got[2]} to {got[3]}, for {n}")
    return rows


def likelihood_of(grid: Grid, p: DataFrame, q: DataFrame) -> float:
    """The log likelihood of (variant_id, p) and (sample_id, q), which have to be of the grid's variants and samples."""
    k = p.agg(F.max(F.size("p"))).first()[0]
    if q.agg(F.min(F.size("q")), F.max(F.size("q"))).first() != (k, k):
        raise ValueError("P and Q have other numbers of columns")
    state = grid.state_of(P, whole_rows(p, "variant_id", grid.n_variants, "P"), "variant_id", "p").unionByName(grid.state_of(Q, whole_rows(q, "sample_id", grid.n_samples, "Q"), "sample_id", "q"))
    return likelihoods(grid, state, k, 1)[0]


# ---- starts ----


def random_start(grid: Grid, k: int, seeds: list[int] | None = None, as_one: bool = False) -> Fit:
    """A member for each seed; rows are drawn by block and by chunk, or those of Q as one sequence of all samples,
    as `fit.random_start` draws them."""
    seeds, cols = seeds or [42], grid.cols

    def make(kind: int, b: int, i: int, n: int) -> np.ndarray:
        if kind == P:
            return kn.clip(np.random.default_rng([seeds[b], 1, i * grid_rows]).random((n, k)))[None]
        rng = np.random.default_rng([seeds[b], 0] if as_one else [seeds[b], 0, i])
        if as_one:
            rng.bit_generator.advance(i * cols * k)
        return kn.normalize(rng.random((n, k)))[None]

    grid_rows = grid.rows
    state = grid.begun(len(seeds), make)
    return Fit(state, k, likelihoods(grid, state, k, len(seeds)))


def supervised_start(grid: Grid, known: DataFrame, seed: int = 42) -> Fit:
    """P from the samples of each label of (sample_id, label), 0.5 where none is called; Q random, labelled
    samples at their population. Labels below 0 and null ones are unknown."""
    k, low, high, n, samples = known.where("label >= 0").agg(F.coalesce(F.max("label"), F.lit(0)) + 1, F.min("sample_id"), F.max("sample_id"), F.count("sample_id"), F.count_distinct("sample_id")).first()
    if k < 2:
        raise ValueError("at least two labels are needed")
    if low < 0 or high >= grid.n_samples or n != samples:
        raise ValueError(f"{n} labels of {samples} samples from {low} to {high}, for {grid.n_samples} samples")

    def make(kind: int, b: int, i: int, n: int) -> np.ndarray:
        return np.full((1, n, k), 0.5) if kind == P else kn.normalize(np.random.default_rng([seed, 0, i]).random((n, k)))[None]

    state = grid.labelled(grid.begun(1, make), known)

    def counts(g: np.ndarray, p: None, q: np.ndarray, at: At) -> tuple:
        own = np.zeros((g.shape[1], k)) if at.labels is None else (at.labels[:, None] == np.arange(k)).astype(float)
        seen = (g != MISSING).astype(float)
        return np.concatenate([np.where(g != MISSING, g, 0) @ own, seen @ own], 1), None, None

    def frequency(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: None) -> tuple:
        alleles, n = np.split(sums, 2, axis=1)
        return kn.clip(np.where(n > 0, alleles / np.maximum(2 * n, 1), 0.5))[None], None

    state = grid.step(state, k, counts, send_q=[0], finish_p=frequency)
    state = grid.step(state, k, finish_q=lambda s, sums, b, i, y: (snapped(s[0], y)[None], None))
    return Fit(state, k, likelihoods(grid, state, k, 1))


def r_factor(grid: Grid, state: DataFrame, width: int, depth_layer: int = 0) -> np.ndarray:
    """The triangular factor of a layer of all chunks: each is factored where it is, and the factors are
    stacked and factored again, FAN at a time, until one is left."""
    size = grid.size

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, b, i, s, _ in rows_of(batch):
                yield state_rows([(SUMS, b, i, np.linalg.qr(layers(s, size(kind, i), width)[depth_layer], mode="r"), None)])

    def merged(t: pa.Table) -> pa.Table:
        stacked = [np.frombuffer(s).reshape(-1, width) for _, s in sorted(zip(t.column("id").to_pylist(), t.column("s").to_pylist()))]
        return pa.Table.from_batches([state_rows([(SUMS, 0, t.column("up")[0].as_py(), np.linalg.qr(np.concatenate(stacked), mode="r"), None)])])

    r = state.where(F.col("kind") == Q).mapInArrow(first, "kind int, b int, id long, s binary, y binary")
    most = grid.chunks
    while True:
        r = r.withColumn("up", F.floor(F.col("id") / FAN)).groupBy("up").applyInArrow(merged, "kind int, b int, id long, s binary, y binary")
        most = -(-most // FAN)
        if most == 1:
            return np.frombuffer(r.first()["s"]).reshape(-1, width)


def with_frequencies(grid: Grid, width: int) -> DataFrame:
    """A state of blocks whose only layer has the allele frequency of each variant in all columns."""
    state = grid.begun(1, lambda kind, b, i, n: np.zeros((1, n, width)))

    def counts(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At) -> tuple:
        seen = g != MISSING
        return np.stack([np.where(seen, g, 0).sum(1), seen.sum(1)], 1), None, None

    def frequency(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: None) -> tuple:
        f = np.where(sums[:, 1] > 0, sums[:, 0] / np.maximum(2.0 * sums[:, 1], 1), 0.0)
        return np.repeat(f[:, None], width, 1)[None], None

    return grid.step(state, width, counts, send_p=[0], finish_p=frequency)


def centred(g: np.ndarray, f: np.ndarray) -> np.ndarray:
    return np.where(g != MISSING, g - 2 * f[:, :1], 0.0)


def times(grid: Grid, state: DataFrame, width: int) -> DataFrame:
    """The state with Z = X V as the second layer of its blocks, V being the first layer of its chunks."""

    def product(g: np.ndarray, f: np.ndarray, v: np.ndarray, at: At) -> tuple:
        return centred(g, f[0]) @ v[0], None, None

    def two(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: None) -> tuple:
        return np.stack([s[0], sums]), (sums.T @ sums).ravel()

    return grid.step(state, width, product, [0], [0], finish_p=two)


def svd(grid: Grid, k: int, seed: int = 42, power: int = 5, tol: float = 0.1) -> tuple[np.ndarray, DataFrame, int]:
    """(S, state, width) of the centred genotypes by a randomized range finder with shifted power passes: the
    chunks have the right singular vectors as their first columns, the blocks their allele frequency.

    The basis is orthonormal by a tree of triangular factors, never as a matrix of all samples.
    """
    width = min(max(k + 10, 20), grid.n_samples)
    state = with_frequencies(grid, width)

    def sketch(g: np.ndarray, f: np.ndarray, v: np.ndarray, at: At) -> tuple:
        return None, centred(g, f[0]).T @ np.random.default_rng([seed, at.row0]).normal(size=(len(g), width)), None

    state = grid.step(state, width, sketch, [0], finish_q=lambda s, sums, b, i, y: (sums[None], None))

    def onto(state: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """The chunks' layer made orthonormal, and its singular values."""
        _, values, right = np.linalg.svd(r_factor(grid, state, width))
        values = np.maximum(values, 1e-15)
        turn = right.T / values
        return grid.step(state, width, finish_q=lambda s, sums, b, i, y: ((s[0] @ turn)[None], None)), values

    state, _ = onto(state)
    shift, before = 0.0, None
    for _ in range(power):
        state = times(grid, state, width)

        def back(g: np.ndarray, p: np.ndarray, v: np.ndarray, at: At) -> tuple:
            return None, centred(g, p[0]).T @ p[1], None

        moved = shift
        state = grid.step(state, width, back, [0, 1], finish_q=lambda s, sums, b, i, y, moved=moved: ((sums - moved * s[0])[None], None))
        state, s = onto(state)
        now = s + shift
        if before is not None and (np.abs(now - before)[:k] / np.maximum(now[:k], 1e-12)).max() < tol:
            break
        before = now
        if s[-1] > shift:
            shift = 0.5 * (s[-1] + shift)
    state = times(grid, state, width)
    d, v = np.linalg.eigh(grid.numbers(state)[0, 1].reshape(width, width))
    order = np.argsort(-d)
    turn = v[:, order]
    state = grid.step(state, width, finish_q=lambda s, sums, b, i, y: ((s[0] @ turn)[None], None))
    return np.sqrt(np.maximum(d[order[:k]], 0)), state, width


def als(grid: Grid, found: tuple[np.ndarray, DataFrame, int], k: int, seed: int = 42, max_iter: int = 100, tol: float = 1e-4) -> Fit:
    """Constrained least squares on the projection Z = X V of the centred matrix, from random P.

    After Z, no pass goes over the genotypes: P from Z and the sums of Q, then Q from V and the sums of P.
    """
    _, state, width = found
    state = times(grid, state, width)
    rows, size = grid.rows, grid.size

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, b, i, s, y in rows_of(batch):
                if kind == SUMS:
                    continue
                x, n = layers(s, size(kind, i), width), size(kind, i)
                if kind == P:
                    start = kn.clip(np.random.default_rng([seed, 1, i * rows]).random((n, k)))
                    yield state_rows([(kind, 0, i, np.stack([start, x[1][:, :k], x[0][:, :k]]), y), (SUMS, 0, 1, sums_p(start, x[1][:, :k], x[0][:, 0]), None)])
                else:
                    yield state_rows([(kind, 0, i, np.stack([np.full((n, k), 1 / k), x[0][:, :k]]), y)])

    def sums_p(p: np.ndarray, z: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.concatenate([(z.T @ p).ravel(), (p.T @ p).ravel(), f @ p])

    state = grid.kept(state.mapInArrow(narrow, "kind int, b int, id long, s binary, y binary"))
    for it in range(max_iter + 1):
        got = grid.numbers(state)[0, 1]
        zp, pp, fp = got[: k * k].reshape(k, k), got[k * k : 2 * k * k].reshape(k, k), got[2 * k * k :]
        inverse = np.linalg.pinv(pp)
        bounded = it > 0

        def new_q(s: np.ndarray, sums: None, b: int, i: int, y: None, zp: np.ndarray = zp, pp: np.ndarray = pp, fp: np.ndarray = fp, inverse: np.ndarray = inverse, bounded: bool = bounded) -> tuple:
            free = 0.5 * s[1] @ (zp @ inverse) + fp @ inverse
            q = kn.normalize(kn.bounded_least_squares(pp, free @ pp) if bounded else free)
            return np.stack([q, s[1]]), np.concatenate([(q.T @ q).ravel(), (s[1].T @ q).ravel(), q.sum(0), [((q - s[0]) ** 2).sum()]])

        state = grid.step(state, k, finish_q=new_q)
        got = grid.numbers(state)[0, 2]
        if bounded and np.sqrt(got[-1] / (grid.n_samples * k)) < tol or it == max_iter:
            break
        a, vq = got[: k * k].reshape(k, k), got[k * k : 2 * k * k].reshape(k, k)
        turn, level = vq @ np.linalg.pinv(a), got[2 * k * k : -1] @ np.linalg.pinv(a)

        def new_p(s: np.ndarray, sums: None, b: int, i: int, y: None, a: np.ndarray = a, turn: np.ndarray = turn, level: np.ndarray = level) -> tuple:
            z, f = s[1], s[2][:, 0]
            p = kn.clip(kn.bounded_least_squares(a, (0.5 * z @ turn + np.outer(f, level)) @ a))
            return np.stack([p, z, s[2]]), sums_p(p, z, f)

        state = grid.step(state, k, finish_p=new_p)
    state = first_layers(grid, state, k)
    return Fit(state, k, likelihoods(grid, state, k, 1))


def first_layers(grid: Grid, state: DataFrame, k: int, which: Callable[[int, int], int] = lambda kind, b: 0) -> DataFrame:
    """One layer of each row, by kind and member."""
    return grid.step(state, k, finish_p=lambda s, sums, b, i, y: (s[which(P, b)][None], None), finish_q=lambda s, sums, b, i, y: (s[which(Q, b)][None], None))


# ---- EM ----


def em_kernel(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At) -> tuple:
    return *kn.em_terms(g, p[0], q[0]), [kn.log_likelihood(g, p[0], q[0])]


def em(grid: Grid, start: Fit, steps: int) -> Fit:
    """Simultaneous EM steps; the likelihood is that before each step and after the last."""
    state, k = start.state, start.k

    def after_p(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: None) -> tuple:
        return kn.em_rows_p(s[0], sums)[None], None

    def after_q(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: np.ndarray | None) -> tuple:
        return snapped(kn.em_rows_q(s[0], sums), y)[None], None

    passes = []
    for _ in range(steps):
        state = grid.step(state, k, em_kernel, [0], [0], after_p, after_q)
        passes.append(state)
    passes.append(grid.step(state, k, lambda g, p, q, at: (None, None, [kn.log_likelihood(g, p[0], q[0])]), [0], [0]))
    got = grid.numbers(*passes)
    course = [[float(got[b, 3 * i][0]) for i in range(len(passes))] for b in range(start.members)]
    return Fit(state, k, [c[-1] for c in course], course)


def adaptive_em(grid: Grid, start: Fit, o: Options = Options(), fixed_p: bool = False) -> Fit:
    """EM differences followed by adaptive moments, one pass a step; with fixed_p only Q moves."""
    k, n = start.k, start.members
    active = list(range(n))

    def grown(s: np.ndarray) -> np.ndarray:
        return s if len(s) == 3 else np.concatenate([s[:1], np.zeros((2, *s.shape[1:]))])

    def plain(state: DataFrame) -> DataFrame:
        def after_p(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: None) -> tuple:
            s = grown(s)
            return np.stack([s[0] if fixed_p else kn.em_rows_p(s[0], sums), s[1], s[2]]), None

        def after_q(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: np.ndarray | None) -> tuple:
            s = grown(s)
            return np.stack([snapped(kn.em_rows_q(s[0], sums), y), s[1], s[2]]), None

        return grid.step(state, k, em_kernel, [0], [0], after_p, after_q)

    def adam(state: DataFrame, t: int, lr: list[float]) -> DataFrame:
        fix1, fix2 = 1 - o.beta1**t, 1 - o.beta2**t

        def moved(s: np.ndarray, to: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = to - s[0]
            m, v = o.beta1 * s[1] + (1 - o.beta1) * d, o.beta2 * s[2] + (1 - o.beta2) * d * d
            return s[0] + rate * (m / fix1) / (np.sqrt(v / fix2) + o.eps), m, v

        def after_p(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: None) -> tuple:
            x, m, v = moved(s, kn.em_rows_p(s[0], sums), lr[b])
            return np.stack([kn.clip(x), m, v]), None

        def after_q(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: np.ndarray | None) -> tuple:
            x, m, v = moved(s, snapped(kn.em_rows_q(s[0], sums), y), lr[b])
            return np.stack([snapped(kn.normalize(x), y), m, v]), None

        return grid.step(state, k, em_kernel, [0], [0], None if fixed_p else after_p, after_q, active)

    state = plain(start.state)
    state = adam(state, 1, [o.lr] * n)
    state = plain(state)
    lr, wait, best = [o.lr] * n, [0] * n, [-np.inf] * n
    kept: list[DataFrame] = [state] * n
    course: list[list[float]] = [[] for _ in range(n)]
    for it in range(o.max_iter + 1):
        before = state
        state = adam(state, it + 2, lr)
        if it % o.check:
            continue
        got = grid.numbers(state)
        for b in list(active):
            ll = float(got[b, 0][0])
            course[b].append(ll)
            if ll > best[b] + o.tol or best[b] == -np.inf:
                best[b], kept[b], wait[b] = ll, before, 0
                continue
            wait[b] += 1
            if wait[b] >= o.patience:
                lr[b], wait[b] = max(lr[b] * o.decay, o.min_lr), 0
                if lr[b] <= o.min_lr:
                    active.remove(b)
        grid.pin(*kept)
        if not active:
            break
    out = first_layers(grid, members_of(kept), k)
    grid.pin(out)
    return Fit(out, k, likelihoods(grid, out, k, n), course)


def members_of(kept: list[DataFrame]) -> DataFrame:
    """A state with each member's rows from a state of its own."""
    out = None
    for one in {id(x): x for x in kept}.values():
        mine = one.where(F.col("b").isin(*(b for b, x in enumerate(kept) if x is one)) & (F.col("kind") != SUMS))
        out = mine if out is None else out.unionByName(mine)
    return out


# ---- quasi-Newton block updates ----


def newton(grid: Grid, start: Fit, o: Options = Options(), fixed_p: bool = False, iterations: int | None = None) -> Fit:
    """Block updates of Q and P by constrained Newton steps, extrapolated by a quasi-Newton rule.

    Five passes an iteration: P's update, Q's update, P's second, the likelihood with Q's next update and
    the sums of the extrapolation, and the same at the extrapolated point. A row's layers are the point, its two
    successors, the extrapolated point, for Q the update that follows from each of the last two, and
    the histories of both differences.
    """
    k, h, n = start.k, o.history, start.members
    head_p, head_q = 4, 6  # layers before the histories
    active = list(range(n))

    def terms(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate(kn.newton_q(g, p, q), axis=1)

    def solved(sums: np.ndarray, q: np.ndarray, y: np.ndarray | None) -> np.ndarray:
        return snapped(kn.to_simplex(kn.box_qp(sums[:, k:], sums[:, :k], q, simplex=True)), y)

    def for_q(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At) -> tuple:
        return None, terms(g, p[0], q[0]), None

    def for_p(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At) -> tuple:
        return np.concatenate(kn.newton_p(g, p[0], q[0]), axis=1), None, None

    def at_point(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At) -> tuple:
        return None, terms(g, p[0], q[0]), [kn.log_likelihood(g, p[0], q[0])]

    def put(s: np.ndarray, to: int, x: np.ndarray) -> np.ndarray:
        s = s.copy()
        s[to] = x
        return s

    def grown(head: int) -> Callable:
        return lambda s, sums, b, i, y: (np.concatenate([np.repeat(s[:1], head, 0), np.zeros((2 * h, *s.shape[1:]))]), None)

    state = grid.step(start.state, k, finish_p=grown(head_p), finish_q=grown(head_q))
    state = grid.step(state, k, for_q, [0], [0], finish_q=lambda s, sums, b, i, y: (put(s, 4, solved(sums, s[0], y)), None))
    base, ahead = [0] * n, [4] * n  # layers of the point and of its update
    last, best, wait = [-np.inf] * n, [-np.inf] * n, [0] * n
    kept: list[tuple[DataFrame, int]] = [(state, 0)] * n
    course: list[list[float]] = [[] for _ in range(n)]

    for it in range(1, (iterations or o.max_iter) + 1):
        slot, used = (it - 1) % h, min(it, h)
        point, update = list(base), list(ahead)

        # the point comes first and its update second while P's first update is made
        def begin_p(s: np.ndarray, sums: np.ndarray | None, b: int, i: int, y: None, point: list[int] = point) -> tuple:
            s = put(s, 0, s[point[b]])
            return put(s, 1, s[0] if sums is None else kn.clip(kn.box_qp(sums[:, k:], sums[:, :k], s[0], simplex=False))), None

        def begin_q(s: np.ndarray, sums: None, b: int, i: int, y: np.ndarray | None, point: list[int] = point, update: list[int] = update) -> tuple:
            s = s.copy()
            s[0], s[1] = s[point[b]].copy(), s[update[b]].copy()
            return s, None

        def second_p(s: np.ndarray, sums: np.ndarray | None, b: int, i: int, y: None) -> tuple:
            return put(s, 2, s[1] if sums is None else kn.clip(kn.box_qp(sums[:, k:], sums[:, :k], s[1], simplex=False))), None

        def second_q(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: np.ndarray | None) -> tuple:
            return put(s, 2, solved(sums, s[1], y)), None

        if fixed_p:
            state = grid.step(state, k, finish_p=begin_p, finish_q=begin_q, active=active)
            state = grid.step(state, k, for_q, [1], [1], second_p, second_q, active)
        else:
            state = grid.step(state, k, for_p, [[x] for x in point], [[x] for x in update], begin_p, begin_q, active)
            state = grid.step(state, k, for_q, [1], [1], finish_q=second_q, active=active)
            state = grid.step(state, k, for_p, [1], [2], second_p, active=active)

        def differences(head: int, slot: int = slot, used: int = used) -> Callable:
            def finish(s: np.ndarray, sums: np.ndarray | None, b: int, i: int, y: np.ndarray | None) -> tuple:
                s = s.copy()
                s[head + slot], s[head + h + slot] = s[1] - s[0], s[2] - s[1]
                u, v = (s[a : a + used].reshape(used, -1) for a in (head, head + h))
                if head == head_q:
                    s[4] = solved(sums, s[2], y)
                return s, np.concatenate([(u @ (u - v).T).ravel(), u @ (s[0] - s[1]).ravel()])

            return finish

        state = grid.step(state, k, at_point, [2], [2], differences(head_p), differences(head_q), active)
        got = grid.numbers(state)
        weights = {}
        for b in active:
            system = got[b, 1] + got[b, 2]
            weights[b] = np.linalg.lstsq(system[: used * used].reshape(used, used), system[used * used :], rcond=None)[0]
        ll2 = {b: float(got[b, 0][0]) for b in active}

        # the extrapolated point, made of the first successor and the second differences
        def far_p(first: np.ndarray, second: np.ndarray, b: int, weights: dict = weights) -> np.ndarray:
            return first if fixed_p else kn.clip(first - np.tensordot(weights[b], second, 1))

        def far_q(first: np.ndarray, second: np.ndarray, b: int, y: np.ndarray | None, weights: dict = weights) -> np.ndarray:
            return snapped(kn.to_simplex(first - np.tensordot(weights[b], second, 1)), y)

        def at_far(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At, far_p: Callable = far_p, far_q: Callable = far_q) -> tuple:
            return at_point(g, far_p(p[0], p[1:], at.b)[None], far_q(q[0], q[1:], at.b, at.labels)[None], at)

        def beyond_p(s: np.ndarray, sums: None, b: int, i: int, y: None, far: Callable = far_p, used: int = used) -> tuple:
            return put(s, 3, far(s[1], s[head_p + h : head_p + h + used], b)), None

        def beyond_q(s: np.ndarray, sums: np.ndarray, b: int, i: int, y: np.ndarray | None, far: Callable = far_q, used: int = used) -> tuple:
            x = far(s[1], s[head_q + h : head_q + h + used], b, y)
            return put(put(s, 3, x), 5, solved(sums, x, y)), None

        histories = [[1, *range(head + h, head + h + used)] for head in (head_p, head_q)]
        state = grid.step(state, k, at_far, *histories, beyond_p, beyond_q, active)
        got = grid.numbers(state)
        for b in list(active):
            llx = float(got[b, 0][0])
            accepted = llx > last[b]
            base[b], ahead[b], ll = (3, 5, llx) if accepted else (2, 4, ll2[b])
            if not np.isfinite(ll):
                raise ArithmeticError(f"the likelihood of iteration {it} is {ll}")
            course[b].append(ll)
            wait[b] = wait[b] + 1 if it > 1 and ll <= best[b] + o.tol else 0
            if ll > best[b]:
                best[b], kept[b] = ll, (state, base[b])
            if iterations is None and (abs(ll - last[b]) < o.tol or wait[b] >= o.patience):
                active.remove(b)
            last[b] = ll
        grid.pin(*(x for x, _ in kept))
        if not active:
            break
    which = [b for _, b in kept]
    out = first_layers(grid, members_of([x for x, _ in kept]), k, lambda kind, b: which[b])
    grid.pin(out)
    return Fit(out, k, best, course)


def project(grid: Grid, p: DataFrame, k: int, o: Options = Options(), adaptive: bool = False) -> Fit:
    """Q of new samples for given P, rows (variant_id, p)."""
    q = grid.begun(1, lambda kind, b, i, n: kn.normalize(np.random.default_rng([o.seed, 0, i]).random((n, k)))[None], (Q,))
    start = Fit(grid.state_of(P, whole_rows(p, "variant_id", grid.n_variants, "P"), "variant_id", "p").unionByName(q), k, [-np.inf])
    return adaptive_em(grid, start, o, fixed_p=True) if adaptive else newton(grid, start, o, fixed_p=True)


# ---- batches: cross-validation and starts ----


def copies(grid: Grid, f: Fit, members: int, b: int = 0) -> Fit:
    """A batch of the same fit."""
    one = f.state.where((F.col("b") == b) & (F.col("kind") != SUMS)).drop("b")
    many = one.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    return Fit(grid.kept(many.select("kind", "b", "id", "s", "y")), f.k, [f.log_likelihood[b]] * members)


def held(at: At, shape: tuple[int, int], n_samples: int, folds: int, seed: int) -> np.ndarray:
    """Whether a tile's genotypes are in the member's fold, by a hash of their place."""
    with np.errstate(over="ignore"):
        rows = (np.arange(shape[0], dtype=np.uint64) + np.uint64(at.row0))[:, None] * np.uint64(n_samples)
        flat = rows + np.arange(at.col0, at.col0 + shape[1], dtype=np.uint64) + np.uint64(seed) + np.uint64(STEP)
    return mixed(flat) % np.uint64(folds) == np.uint64(at.b)


def cross_validate(grid: Grid, f: Fit, folds: int = 5, seed: int = 42, iterations: int = 5, o: Options = Options()) -> float:
    """Mean half deviance of held-out genotypes: for each fold, `iterations` updates without it from the
    whole fit, all folds in the same passes."""
    n = grid.n_samples
    part = grid.changed(lambda g, at: np.where(held(at, g.shape, n, folds, seed), MISSING, g).astype(np.uint8))
    got = newton(part, copies(grid, f, folds), Options(tol=0.0, patience=iterations + 1, history=o.history), iterations=iterations)

    def score(g: np.ndarray, p: np.ndarray, q: np.ndarray, at: At) -> tuple:
        out = held(at, g.shape, n, folds, seed) & (g != MISSING)
        mu, x = np.clip(2 * (p[0] @ q[0].T)[out], 1e-10, 2 - 1e-10), g[out].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / mu), 0) + np.where(x < 2, (2 - x) * np.log(np.maximum(2 - x, 1e-300) / (2 - mu)), 0)
        return None, None, [d.sum(), len(x)]

    sums = grid.numbers(grid.step(got.state, f.k, score, [0], [0]))
    total = np.sum([sums[b, 0] for b in range(folds)], axis=0)
    return float(total[0] / total[1])


def best_of(grid: Grid, f: Fit) -> Fit:
    """The member of highest likelihood, the first of equal ones."""
    b = int(np.argmax(f.log_likelihood))
    return copies(grid, f, 1, b)


def train(grid: Grid, k: int, method: str = "newton", start: str = "als", o: Options = Options(), found: tuple[np.ndarray, DataFrame, int] | None = None, n_starts: int = 1) -> Fit:
    """One fit: of n_starts starts, which go through the same passes, the one of best likelihood is optimised."""
    if k < 2:
        raise ValueError("at least two populations are needed")
    if start == "als":
        found = found or svd(grid, k, o.seed)
        starts = [als(grid, found, k, o.seed + i, o.als_iter) for i in range(n_starts)]
        first = max(starts, key=lambda f: f.log_likelihood[0])
    else:
        first = best_of(grid, em(grid, random_start(grid, k, [o.seed + i for i in range(n_starts)]), o.em_steps))
    return (newton if method == "newton" else adaptive_em)(grid, first, o)


# ---- sweeps over the number of populations ----


def column_costs(grid: Grid, a: Fit, b: Fit) -> np.ndarray:
    """Mean squared differences of the columns of one Q to those of another, added up by chunk."""
    size, ka, kb = grid.size, a.k, b.k
    left = a.state.where((F.col("kind") == Q) & (F.col("b") == 0)).select("id", F.col("s").alias("sa"))
    right = b.state.where((F.col("kind") == Q) & (F.col("b") == 0)).select("id", F.col("s").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("id", "sa", "sb"))):
                x, y = layers(sa, size(Q, i), ka)[0], layers(sb, size(Q, i), kb)[0]
                yield state_rows([(SUMS, 0, 0, ((x[:, :, None] - y[:, None, :]) ** 2).sum(0), None)])

    found = left.join(right, "id").mapInArrow(run, "kind int, b int, id long, s binary, y binary")
    return grid.numbers(found)[0, 0].reshape(ka, kb) / grid.n_samples


def permuted(grid: Grid, f: Fit, order: list[int]) -> Fit:
    """The fit with its columns in another order."""

    def turned(s: np.ndarray, sums: None, b: int, i: int, y: None) -> tuple:
        return s[:, :, order], None

    return Fit(grid.step(f.state, f.k, finish_p=turned, finish_q=turned), f.k, f.log_likelihood, f.course)


@dataclass
class Stage:
    """One K of a sweep as it was written."""

    fit: Fit
    iterations: int
    cv_index: float | None


def sweep(grid: Grid, ks: list[int], folder: str, o: Options = Options(), folds: int = 0, start: str = "als", n_starts: int = 1) -> dict[int, Stage]:
    """A fit for each K from one SVD of the largest, its columns in the order of the K before, and with folds
    its cross-validation index.

    Each K is a stage: its state is written to `folder`, and after it a row that says so. A sweep that is
    begun again reads the stages that are there and goes on with the next, so what ends it costs one K.
    """
    spark, found, before = grid.spark, None, None
    out: dict[int, Stage] = {}
    for k in sorted(ks):
        done, kept = f"{folder}/k={k}/summary", f"{folder}/k={k}/state"
        if not exists(spark, f"{done}/_SUCCESS"):
            if start == "als" and found is None:
                found = svd(grid, max(ks), o.seed)
                grid.pin(found[1])
                found = (found[0], durable(found[1]), found[2])
            f = train(grid, k, start=start, o=o, found=found, n_starts=n_starts)
            if before is not None:
                f = permuted(grid, f, column_order(column_costs(grid, f, before)))
            f.state.where(F.col("kind") != SUMS).write.mode("overwrite").parquet(kept)
            f.state = spark.read.parquet(kept)
            cv = cross_validate(grid, f, folds, o.seed, o=o) if folds else None
            row = [(k, f.log_likelihood[0], len(f.course[0]), cv, json.dumps(f.course[0]))]
            spark.createDataFrame(row, "k int, log_likelihood double, iterations int, cv_index double, course string").coalesce(1).write.mode("overwrite").parquet(done)
        r = spark.read.parquet(done).first()
        before = Fit(spark.read.parquet(kept), k, [r["log_likelihood"]], [json.loads(r["course"])])
        out[k] = Stage(before, r["iterations"], r["cv_index"])
    return out


def write_sweep(grid: Grid, stages: dict[int, Stage], folder: str, name: str) -> None:
    """The text files of P and Q of each K, and of the cross-validation indices."""
    for k, s in stages.items():
        write_fit(q_rows(grid, s.fit), p_rows(grid, s.fit), folder, name, k)
    rows = [(k, s.cv_index) for k, s in stages.items() if s.cv_index is not None]
    if rows:
        write_cv(grid.spark.createDataFrame(rows, "k int, cv_index double"), f"{folder}/{name}.cv")
