"""Numpy kernels on one block of variants: likelihood, EM sums, Newton blocks, small solvers."""

from __future__ import annotations

import numpy as np

from .expr import EPS, MISSING


def clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, EPS, 1 - EPS)


def normalize(q: np.ndarray) -> np.ndarray:
    q = clip(q)
    return q / q.sum(1, keepdims=True)


def log_likelihood(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> float:
    r = p @ q.T
    seen = g != MISSING
    return float((np.where(seen, g, 0) * np.log(r) + np.where(seen, 2.0 - g, 0) * np.log1p(-r)).sum())


def em_sums(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next P rows, T by sample, alleles called by sample)."""
    r = p @ q.T
    seen = g != MISSING
    a, b = np.where(seen, g / r, 0.0), np.where(seen, (2.0 - g) / (1 - r), 0.0)
    top, rest = a @ q, b @ q
    under = p * (top - rest) + rest
    new_p = np.where(under > 0, clip(top * p / np.where(under > 0, under, 1)), p)
    return new_p, (a - b).T @ p + b.sum(0)[:, None], 2.0 * seen.sum(0)


def em_terms(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What some variants of some samples add to the sums of an EM step: by variant the two sums that
    its new row is made of, by sample T and the alleles called."""
    r = p @ q.T
    seen = g != MISSING
    a, b = np.where(seen, g / r, 0.0), np.where(seen, (2.0 - g) / (1 - r), 0.0)
    return np.concatenate([a @ q, b @ q], 1), np.concatenate([(a - b).T @ p + b.sum(0)[:, None], 2.0 * seen.sum(0)[:, None]], 1)


def em_rows_p(p: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Rows of P after an EM step."""
    top, rest = np.split(sums, 2, axis=1)
    under = p * (top - rest) + rest
    return np.where(under > 0, clip(top * p / np.where(under > 0, under, 1)), p)


def em_rows_q(q: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Rows of Q after an EM step; those of samples without a genotype stay."""
    t, n = sums[:, :-1], sums[:, -1:]
    return np.where(n > 0, normalize(q * t / np.maximum(n, 1)), q)


def newton_q(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.clip(p @ q.T, 1e-10, 1 - 1e-10)
    seen = g != MISSING
    u, w = np.where(seen, g / r, 0.0), np.where(seen, (2.0 - g) / (1 - r), 0.0)
    z = 1 - p
    grad = u.T @ p + w.T @ z
    pp, zz = (np.einsum("jk,jl->jkl", x, x).reshape(len(p), -1) for x in (p, z))
    return grad, (u / r).T @ pp + (w / (1 - r)).T @ zz


def newton_p(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r = np.clip(p @ q.T, 1e-10, 1 - 1e-10)
    seen = g != MISSING
    u, w = np.where(seen, g / r, 0.0), np.where(seen, (2.0 - g) / (1 - r), 0.0)
    qq = np.einsum("ik,il->ikl", q, q).reshape(len(q), -1)
    return (u - w) @ q, (u / r + w / (1 - r)) @ qq


def box_qp(h: np.ndarray, grad: np.ndarray, x: np.ndarray, simplex: bool) -> np.ndarray:
    """For each row, x + d with d the least of d'Hd/2 - grad'd, 0 <= x + d <= 1, and, on the simplex,
    the elements summing to 1.

    A primal active-set method on all rows at once: the step on the free elements is solved for, cut
    at the first bound, which then is held; when a full step was taken, the held element whose
    gradient points inward most is freed. Rows without a descent left are done.
    """
    n, k = x.shape
    h = h.reshape(n, k, k) + 1e-9 * np.trace(h.reshape(n, k, k), axis1=1, axis2=2)[:, None, None] * np.eye(k) / k
    x = x.copy()
    target = 1 - x.sum(1) if simplex else np.zeros(n)
    y, free = x.copy(), (x > 1e-12) & (x < 1 - 1e-12)
    if simplex:
        y += (target / k)[:, None]
        y = np.clip(y, 0, 1)
    live = np.arange(n)
    for _ in range(12 * k):
        if not len(live):
            break
        f, hl = free[live], h[live]
        res = grad[live] - np.einsum("ikl,il->ik", hl, y[live] - x[live])  # minus the gradient at y
        m = k + simplex
        a, b = np.zeros((len(live), m, m)), np.zeros((len(live), m))
        a[:, :k, :k] = np.where(f[:, :, None] & f[:, None, :], hl, 0)
        a[:, np.arange(k), np.arange(k)] += ~f
        b[:, :k] = np.where(f, res, 0)
        if simplex:
            a[:, :k, k] = f
            a[:, k, :k] = f
            a[:, k, k] = ~f.any(1)
        step = np.linalg.solve(a, b[:, :, None])[:, :, 0]
        d = np.where(f, step[:, :k], 0)
        nu = step[:, k] if simplex else np.zeros(len(live))
        yl = y[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(d > 1e-14, (1 - yl) / d, np.where(d < -1e-14, -yl / d, np.inf))
        far = room.min(1)
        cut = far < 1
        yl = np.clip(yl + np.minimum(far, 1)[:, None] * d, 0, 1)
        y[live] = yl
        rows = np.flatnonzero(cut)
        free[live[rows], room[rows].argmin(1)] = False
        full = np.flatnonzero(~cut)
        if len(full):
            at = live[full]
            slope = grad[at] - np.einsum("ikl,il->ik", h[at], y[at] - x[at]) - nu[full][:, None]
            inward = np.where(~free[at], np.where(y[at] <= 1e-12, slope, -slope), -np.inf)
            best = inward.argmax(1)
            go = inward[np.arange(len(at)), best] > 1e-9 * (1 + np.abs(grad[at]).max(1))
            free[at[go], best[go]] = True
            done = np.zeros(len(live), bool)
            done[full[~go]] = True
            live = live[~done]
    return y


def to_simplex(b: np.ndarray) -> np.ndarray:
    """The nearest rows with elements of at least EPS that sum to 1."""
    k = b.shape[1]
    x = b - EPS
    falling = -np.sort(-x, axis=1)
    theta = (np.cumsum(falling, 1) - (1 - k * EPS)) / np.arange(1, k + 1)
    ok = np.concatenate([theta[:, :-1] >= falling[:, 1:], np.ones((len(b), 1), bool)], 1)
    return np.maximum(x - theta[np.arange(len(b)), ok.argmax(1)][:, None], 0) + EPS


def bounded_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of b, the x in [0, 1] that is least in x'Ax/2 - b'x: the free solution where it
    lies in the box, else the box's own problem from its nearest point."""
    x = np.linalg.lstsq(a, b.T, rcond=None)[0].T
    out = np.flatnonzero(((x < 0) | (x > 1)).any(1))
    if len(out):
        x[out] = x[out].clip(0, 1)
        x[out] = box_qp(np.tile(a.ravel(), (len(out), 1)), b[out] - x[out] @ a, x[out], simplex=False)
    return x
