"""Fits of the admixture model: SVD and ALS starts, EM, adaptive EM, quasi-Newton block updates,
projection, supervised fits, cross-validation and sweeps over the number of populations.

Each is a driver loop over passes of `Blocks`; P stays with the blocks, Q is on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import kernels as kn
from ..functions.expr import EPS, MISSING
from ..operators.align import permutation
from ..operators.folds import STEP, mixed
from .blocks import Blocks, Finish


@dataclass(frozen=True)
class Options:
    max_iter: int = 200
    tol: float = 0.1
    patience: int = 3
    history: int = 3
    lr: float = 0.005
    beta1: float = 0.80
    beta2: float = 0.88
    eps: float = 1e-8
    decay: float = 0.5
    min_lr: float = 1e-4
    check: int = 5
    seed: int = 42
    em_steps: int = 5
    als_iter: int = 100

    def __post_init__(self) -> None:
        if self.max_iter < 1 or self.history < 1 or self.patience < 1 or self.check < 1:
            raise ValueError("max_iter, history, patience and check have to be at least 1")
        if not (0 < self.lr and 0 <= self.beta1 < 1 and 0 <= self.beta2 < 1 and 0 < self.decay < 1):
            raise ValueError("lr, beta1, beta2 or decay is out of range")


def options_of(named: dict[str, str]) -> Options:
    """Options from text, as settings files and command lines have it; an unknown name is an error."""
    kinds = {f.name: type(f.default) for f in fields(Options)}
    if unknown := sorted(set(named) - set(kinds)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Options(**{k: kinds[k](float(v)) if kinds[k] is int else float(v) for k, v in named.items()})


@dataclass
class Fit:
    """P as a state table of depth 1, Q on the driver, the likelihood and its course."""

    p: DataFrame
    q: np.ndarray
    log_likelihood: float
    course: list[float] = field(default_factory=list)


# ---- starts ----


def frequencies(g: np.ndarray) -> np.ndarray:
    seen = g != MISSING
    n = seen.sum(1)
    return np.where(n > 0, np.where(seen, g, 0).sum(1) / np.maximum(2.0 * n, 1), 0.0)


def centred(g: np.ndarray) -> np.ndarray:
    return np.where(g != MISSING, g - 2 * frequencies(g)[:, None], 0.0)


def eigen_svd(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and values of a tall matrix, largest first."""
    d, v = np.linalg.eigh(y.T @ y)
    s = np.sqrt(np.maximum(d[::-1], 1e-30))
    return y @ (v[:, ::-1] / s), s


def svd(blocks: Blocks, k: int, seed: int = 42, power: int = 5, tol: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(S, V) of the centred genotypes by a randomized range finder with shifted power passes."""
    n, width = blocks.n_samples, min(max(k + 10, 20), blocks.n_samples)

    def sketch(g: np.ndarray, _: np.ndarray, row0: int) -> tuple[None, list[np.ndarray]]:
        return None, [centred(g).T @ np.random.default_rng([seed, row0]).normal(size=(len(g), width))]

    y = blocks.run(sketch, None, 1, 1, [(n, width)])[1][0]
    o, shift, before = eigen_svd(y)[0], 0.0, None
    for _ in range(power):
        basis = o

        def again(g: np.ndarray, _: np.ndarray, row0: int, basis: np.ndarray = basis) -> tuple[None, list[np.ndarray]]:
            x = centred(g)
            return None, [x.T @ (x @ basis)]

        o, s = eigen_svd(blocks.run(again, None, 1, 1, [(n, width)])[1][0] - shift * basis)
        now = s + shift
        if before is not None and (np.abs(now - before)[:k] / np.maximum(now[:k], 1e-12)).max() < tol:
            break
        before = now
        if s[-1] > shift:
            shift = 0.5 * (s[-1] + shift)
    basis = o

    def gram(g: np.ndarray, _: np.ndarray, row0: int) -> tuple[None, list[np.ndarray]]:
        z = centred(g) @ basis
        return None, [z.T @ z]

    d, v = np.linalg.eigh(blocks.run(gram, None, 1, 1, [(width, width)])[1][0])
    order = np.argsort(-d)[:k]
    return np.sqrt(np.maximum(d[order], 0)), basis @ v[:, order]


def als(blocks: Blocks, v: np.ndarray, k: int, seed: int = 42, max_iter: int = 200, tol: float = 1e-4) -> Fit:
    """Constrained least squares on the centred matrix's projection Z = XV, from random P.

    A block's state holds P, Z and f; a pass gives its new P and its sums Z'P, P'P and f'P.
    """
    v, n = v[:, :k], blocks.n_samples

    def begin(g: np.ndarray, _: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
        x, f = centred(g), frequencies(g)
        p = kn.clip(np.random.default_rng([seed, 1, row0]).random((len(g), k)))
        return np.stack([p, x @ v, np.tile(f[:, None], k)]), als_sums(p, x @ v, f)

    state, sums = blocks.run(begin, None, 3, k, [(k, k), (k, k), (k,)])

    def q_from(zp: np.ndarray, pp: np.ndarray, fp: np.ndarray, bounded: bool) -> np.ndarray:
        inverse = np.linalg.pinv(pp)
        free = 0.5 * v @ (zp @ inverse) + fp @ inverse
        return kn.normalize(kn.bounded_least_squares(pp, free @ pp) if bounded else free)

    q = q_from(*sums, bounded=False)
    for _ in range(max_iter):
        a = q.T @ q
        inverse = q @ np.linalg.pinv(a)

        def step(g: np.ndarray, s: np.ndarray, row0: int, a: np.ndarray = a, iq: np.ndarray = inverse) -> tuple[np.ndarray, list[np.ndarray]]:
            z, f = s[1], s[2][:, 0]
            free = 0.5 * z @ (v.T @ iq) + np.outer(f, iq.sum(0))
            p = kn.clip(kn.bounded_least_squares(a, free @ a))
            return np.stack([p, z, s[2]]), als_sums(p, z, f)

        state, sums = blocks.run(step, state, 3, k, [(k, k), (k, k), (k,)])
        new = q_from(*sums, bounded=True)
        done = np.sqrt(((new - q) ** 2).mean()) < tol
        q = new
        if done:
            break

    def last(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
        return s[:1], [np.array([kn.log_likelihood(g, s[0], q)])]

    state, (ll,) = blocks.run(last, state, 3, k, [(1,)])
    assert len(q) == n
    return Fit(state, q, float(ll[0]))


def als_sums(p: np.ndarray, z: np.ndarray, f: np.ndarray) -> list[np.ndarray]:
    return [z.T @ p, p.T @ p, f @ p]


def random_start(blocks: Blocks, k: int, seed: int = 42) -> Fit:
    q = kn.normalize(np.random.default_rng([seed, 0]).random((blocks.n_samples, k)))

    def begin(g: np.ndarray, _: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
        p = kn.clip(np.random.default_rng([seed, 1, row0]).random((len(g), k)))
        return p[None], [np.array([kn.log_likelihood(g, p, q)])]

    state, (ll,) = blocks.run(begin, None, 1, k, [(1,)])
    return Fit(state, q, float(ll[0]))


def supervised_start(blocks: Blocks, y: np.ndarray, seed: int = 42) -> Fit:
    """y: population of each sample from 0, -1 for unlabelled ones."""
    k = int(y.max()) + 1
    if k < 2:
        raise ValueError("at least two labels are needed")
    q = snapped(kn.normalize(np.random.default_rng([seed, 0]).random((len(y), k))), y)

    def begin(g: np.ndarray, _: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
        seen = g != MISSING
        p = np.full((len(g), k), 0.5)
        for i in range(k):
            n = seen[:, y == i].sum(1)
            p[:, i] = np.where(n > 0, np.where(seen, g, 0)[:, y == i].sum(1) / np.maximum(2.0 * n, 1), 0.5)
        return kn.clip(p)[None], [np.array([kn.log_likelihood(g, kn.clip(p), q)])]

    state, (ll,) = blocks.run(begin, None, 1, k, [(1,)])
    return Fit(state, q, float(ll[0]))


def snapped(q: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    """Labelled rows at their population."""
    if y is None:
        return q
    q, k = q.copy(), q.shape[1]
    known = np.flatnonzero(y >= 0)
    q[known] = EPS / (k - 1)
    q[known, y[known]] = 1 - EPS
    return q


# ---- EM ----


def em(blocks: Blocks, start: Fit, steps: int, y: np.ndarray | None = None) -> Fit:
    """Simultaneous EM steps; the likelihood is that before each step and after the last."""
    state, q, k = start.p, start.q, start.q.shape[1]
    course = []
    for _ in range(steps):

        def step(g: np.ndarray, s: np.ndarray, row0: int, q: np.ndarray = q) -> tuple[np.ndarray, list[np.ndarray]]:
            p, t, n = kn.em_sums(g, s[0], q)
            return p[None], [t, n, np.array([kn.log_likelihood(g, s[0], q)])]

        state, (t, n, ll) = blocks.run(step, state, 1, k, [(len(q), k), (len(q),), (1,)])
        course.append(float(ll[0]))
        q = em_q(q, t, n, y)
    ll = likelihood(blocks, state, q)
    return Fit(state, q, ll, [*course, ll])


def em_q(q: np.ndarray, t: np.ndarray, n: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    new = kn.normalize(q * t / np.maximum(n, 1)[:, None])
    return snapped(np.where(n[:, None] > 0, new, q), y)


def likelihood(blocks: Blocks, state: DataFrame, q: np.ndarray, depth: int = 1) -> float:
    def one(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[None, list[np.ndarray]]:
        return None, [np.array([kn.log_likelihood(g, s[0], q)])]

    return float(blocks.run(one, state, depth, q.shape[1], [(1,)])[1][0][0])


def adaptive_em(blocks: Blocks, start: Fit, o: Options = Options(), y: np.ndarray | None = None) -> Fit:
    """EM differences followed by adaptive moments. One pass a step: each gives the new P with its
    moments, the sums of Q's step, and the likelihood before it."""
    k, q = start.q.shape[1], start.q
    state = start.p
    course: list[float] = []

    def plain(q: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        def step(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
            p, t, n = kn.em_sums(g, s[0], q)
            return np.concatenate([p[None], s[1:] if len(s) == 3 else np.zeros((2, *p.shape))]), [t, n]

        new, (t, n) = blocks.run(step, state, depth, k, [(len(q), k), (len(q),)])
        return new, em_q(q, t, n, y)

    def adam(q: np.ndarray, t_step: int, lr: float) -> tuple[DataFrame, np.ndarray, float]:
        fix1, fix2 = 1 - o.beta1**t_step, 1 - o.beta2**t_step

        def step(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
            p, t, n = kn.em_sums(g, s[0], q)
            d = p - s[0]
            m, v = o.beta1 * s[1] + (1 - o.beta1) * d, o.beta2 * s[2] + (1 - o.beta2) * d * d
            moved = kn.clip(s[0] + lr * (m / fix1) / (np.sqrt(v / fix2) + o.eps))
            return np.stack([moved, m, v]), [t, n, np.array([kn.log_likelihood(g, s[0], q)])]

        new, (t, n, ll) = blocks.run(step, state, 3, k, [(len(q), k), (len(q),), (1,)])
        d = em_q(q, t, n, y) - q
        moments[0] = o.beta1 * moments[0] + (1 - o.beta1) * d
        moments[1] = o.beta2 * moments[1] + (1 - o.beta2) * d * d
        return new, snapped(kn.normalize(q + lr * (moments[0] / fix1) / (np.sqrt(moments[1] / fix2) + o.eps)), y), float(ll[0])

    moments = [np.zeros_like(q), np.zeros_like(q)]
    depth = 1
    state, q = plain(q)
    depth = 3
    state, q, _ = adam(q, 1, o.lr)
    state, q = plain(q)
    lr, wait, best, kept = o.lr, 0, -np.inf, (state, q)
    for it in range(o.max_iter + 1):
        before = (state, q)
        state, q, ll = adam(q, it + 2, lr)
        if it % o.check:
            continue
        course.append(ll)
        if ll > best + o.tol or best == -np.inf:
            best, kept, wait = ll, before, 0
            continue
        wait += 1
        if wait >= o.patience:
            lr = max(lr * o.decay, o.min_lr)
            if lr <= o.min_lr:
                break
            wait = 0

    best_q = kept[1]

    def first(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
        return s[:1], [np.array([kn.log_likelihood(g, s[0], best_q)])]

    p, (ll,) = blocks.run(first, kept[0], 3, k, [(1,)])
    return Fit(p, best_q, float(ll[0]), course)


# ---- quasi-Newton block updates ----


def newton(blocks: Blocks, start: Fit, o: Options = Options(), y: np.ndarray | None = None, fixed_p: bool = False, iterations: int | None = None) -> Fit:
    """Block updates of Q and P by constrained Newton steps, extrapolated by a quasi-Newton rule.

    Three passes an iteration: P's first update with the sums for Q's second; P's second update with
    the likelihood and the sums of the extrapolation; the extrapolated point's likelihood with its
    sums for Q's next update, which are used again if the point is accepted. A block's state holds
    P, its two successors, the extrapolated P, and the histories of both differences.
    """
    k, h, q = start.q.shape[1], o.history, start.q
    depth = 4 + 2 * h

    def terms(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.concatenate(kn.newton_q(g, p, q), axis=1)

    def solver(at: np.ndarray) -> Finish:
        def solved(sums: np.ndarray, first: int) -> np.ndarray:
            some = slice(first, first + len(sums))
            return snapped(kn.to_simplex(kn.box_qp(sums[:, k:], sums[:, :k], at[some], simplex=True)), None if y is None else y[some])

        return solved

    def begin(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.concatenate([s, np.repeat(s, 3, 0), np.zeros((2 * h, *s[0].shape))]), [terms(g, s[0], q)]

    state, (ahead,) = blocks.run(begin, start.p, 1, k, [], solver(q))
    uq, vq = np.zeros((h, *q.shape)), np.zeros((h, *q.shape))
    last, best, kept, wait, course = -np.inf, -np.inf, None, 0, []

    for it in range(1, (iterations or o.max_iter) + 1):
        slot, used = (it - 1) % h, min(it, h)
        q1 = ahead

        def one(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
            s = s.copy()
            if not fixed_p:
                grad, hess = kn.newton_p(g, s[0], q1)
                s[1] = kn.clip(kn.box_qp(hess, grad, s[0], simplex=False))
            return s, [terms(g, s[1], q1)]

        state, (q2,) = blocks.run(one, state, depth, k, [], solver(q1))
        uq[slot], vq[slot] = q1 - q, q2 - q1

        def two(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
            s = s.copy()
            if not fixed_p:
                grad, hess = kn.newton_p(g, s[1], q2)
                s[2] = kn.clip(kn.box_qp(hess, grad, s[1], simplex=False))
            s[4 + slot], s[4 + h + slot] = s[1] - s[0], s[2] - s[1]
            u, v = (s[a : a + used].reshape(used, -1) for a in (4, 4 + h))
            return s, [u @ (u - v).T, u @ (s[0] - s[1]).ravel(), np.array([kn.log_likelihood(g, s[2], q2)]), terms(g, s[2], q2)]

        state, (left, right, ll2, after) = blocks.run(two, state, depth, k, [(used, used), (used,), (1,)], solver(q2))
        fu, fv = uq[:used].reshape(used, -1), vq[:used].reshape(used, -1)
        coefficients = np.linalg.lstsq(left + fu @ (fu - fv).T, right + fu @ (q - q1).ravel(), rcond=None)[0]
        qx = snapped(kn.to_simplex(q1 - np.tensordot(coefficients, vq[:used], 1)), y)

        def far(g: np.ndarray, s: np.ndarray, row0: int) -> tuple[np.ndarray, list[np.ndarray]]:
            s = s.copy()
            if not fixed_p:
                s[3] = kn.clip(s[1] - np.tensordot(coefficients, s[4 + h : 4 + h + used], 1))
            return s, [np.array([kn.log_likelihood(g, s[3], qx)]), terms(g, s[3], qx)]

        state, (llx, beyond) = blocks.run(far, state, depth, k, [(1,)], solver(qx))
        accepted = float(llx[0]) > last
        q, ahead, ll = (qx, beyond, float(llx[0])) if accepted else (q2, after, float(ll2[0]))
        state = moved(state, depth, k, 3 if accepted else 2)
        course.append(ll)
        wait = wait + 1 if it > 1 and ll <= best + o.tol else 0
        if ll > best:
            best, kept = ll, (state, q)
        stop = iterations is None and (abs(ll - last) < o.tol or wait >= o.patience)
        last = ll
        if stop:
            break
    return Fit(moved(kept[0], depth, k, 0, 1), kept[1], best, course)


def moved(state: DataFrame, depth: int, width: int, layer: int, keep: int | None = None) -> DataFrame:
    """A state with one of its layers put first; `keep` layers are kept, or all. Computed in the next pass."""

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for s in p["s"]:
                x = np.frombuffer(s).reshape(depth, -1, width).copy()
                x[0] = x[layer]
                out.append(x[:keep].tobytes())
            yield pd.DataFrame({"block": p["block"], "s": out})

    return state.mapInPandas(one, "block long, s binary")


def project(blocks: Blocks, p: DataFrame, k: int, o: Options = Options(), adaptive: bool = False) -> Fit:
    """Q of new samples for a given P (a state of depth 1)."""
    q = kn.normalize(np.random.default_rng([o.seed, 0]).random((blocks.n_samples, k)))
    start = Fit(p, q, -np.inf)
    if not adaptive:
        return newton(blocks, start, o, fixed_p=True)
    m, v, best = np.zeros_like(q), np.zeros_like(q), Fit(p, q, -np.inf)
    for it in range(1, o.max_iter + 1):

        def step(g: np.ndarray, s: np.ndarray, row0: int, q: np.ndarray = q) -> tuple[None, list[np.ndarray]]:
            _, t, n = kn.em_sums(g, s[0], q)
            return None, [t, n, np.array([kn.log_likelihood(g, s[0], q)])]

        _, (t, n, ll) = blocks.run(step, p, 1, k, [q.shape, (len(q),), (1,)])
        if float(ll[0]) <= best.log_likelihood + o.tol and it > 1:
            break
        best = Fit(p, q, float(ll[0]), [*best.course, float(ll[0])])
        d = em_q(q, t, n) - q
        m, v = o.beta1 * m + (1 - o.beta1) * d, o.beta2 * v + (1 - o.beta2) * d * d
        q = kn.normalize(q + d + o.lr * (m / (1 - o.beta1**it)) / (np.sqrt(v / (1 - o.beta2**it)) + o.eps))
    return best


# ---- cross-validation and sweeps ----


def cross_validate(blocks: Blocks, fit: Fit, folds: int = 5, seed: int = 42, iterations: int = 5, o: Options = Options()) -> float:
    """Mean half deviance of held-out genotypes: for each fold, `iterations` updates without it from
    the whole fit. Folds are a hash of a genotype's place, made anew in each pass."""
    n = blocks.n_samples

    def held(shape: tuple[int, int], row0: int, fold: int) -> np.ndarray:
        flat = ((np.arange(shape[0], dtype=np.uint64) + np.uint64(row0))[:, None] * np.uint64(n) + np.arange(n, dtype=np.uint64)) + np.uint64(seed) + np.uint64(STEP)
        return mixed(flat) % np.uint64(folds) == np.uint64(fold)

    total, count = 0.0, 0.0
    for fold in range(folds):
        part = Masked(blocks, lambda g, row0, fold=fold: np.where(held(g.shape, row0, fold), MISSING, g).astype(np.uint8))
        got = newton(part, fit, Options(tol=0.0, patience=iterations + 1, history=o.history), iterations=iterations)

        def score(g: np.ndarray, s: np.ndarray, row0: int, q: np.ndarray = got.q, fold: int = fold) -> tuple[None, list[np.ndarray]]:
            out = held(g.shape, row0, fold) & (g != MISSING)
            mu = np.clip(2 * (s[0] @ q.T)[out], 1e-10, 2 - 1e-10)
            x = g[out].astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                d = np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / mu), 0) + np.where(x < 2, (2 - x) * np.log(np.maximum(2 - x, 1e-300) / (2 - mu)), 0)
            return None, [np.array([d.sum(), len(x)])]

        d, c = blocks.run(score, got.p, 1, got.q.shape[1], [(2,)])[1][0]
        total, count = total + d, count + c
    return float(total / count)


@dataclass
class Masked(Blocks):
    """Blocks whose genotypes a function changes in every pass."""

    def __init__(self, blocks: Blocks, change) -> None:
        super().__init__(blocks.frame, blocks.n_variants, blocks.n_samples)
        self.change = change

    def run(self, kernel, state, depth, width, shapes, finish=None):
        change = self.change
        return super().run(lambda g, s, row0: kernel(change(g, row0), s, row0), state, depth, width, shapes, finish)


def train(blocks: Blocks, k: int, method: str = "newton", start: str = "als", o: Options = Options(), v: np.ndarray | None = None, n_starts: int = 1) -> Fit:
    """One fit: of n_starts starts the one of best likelihood is optimised."""
    if k < 2:
        raise ValueError("at least two populations are needed")
    starts = []
    for i in range(n_starts):
        if start == "als":
            starts.append(als(blocks, svd(blocks, k, o.seed + i)[1] if v is None else v, k, o.seed + i, o.als_iter))
        else:
            starts.append(em(blocks, random_start(blocks, k, o.seed + i), o.em_steps))
    first = max(starts, key=lambda f: f.log_likelihood)
    return (newton if method == "newton" else adaptive_em)(blocks, first, o)


def sweep(blocks: Blocks, ks: list[int], o: Options = Options(), folds: int = 0) -> dict[int, tuple[Fit, float | None]]:
    """A fit for each k from one SVD of the largest, its columns aligned to those of the k before."""
    v = svd(blocks, max(ks), o.seed)[1]
    out: dict[int, tuple[Fit, float | None]] = {}
    before = None
    for k in sorted(ks):
        f = train(blocks, k, o=o, v=v)
        if before is not None:
            f = permuted(f, permutation(before, f.q))
        before = f.q
        out[k] = (f, cross_validate(blocks, f, folds, o.seed, o=o) if folds else None)
    return out


def permuted(f: Fit, order: list[int]) -> Fit:
    k = len(order)

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"block": p["block"], "s": [np.ascontiguousarray(np.frombuffer(s).reshape(-1, k)[:, order]).tobytes() for s in p["s"]]})

    return Fit(f.p.mapInPandas(one, "block long, s binary"), f.q[:, order], f.log_likelihood, f.course)
