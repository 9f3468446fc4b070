"""Singular values and right singular vectors of a small square matrix, by way of a bidiagonal one.

Householder reflections from both sides leave an upper bidiagonal matrix. The squares of
its singular values come from dqds: quotient-difference sweeps with shifts below the
smallest value left, each of which keeps all values to high relative accuracy. A vector
comes from a twisted factorisation of the shifted tridiagonal product: factors from the top
and from the bottom meet where the pivot is least, and its solution needs no iteration but
multiplications along the diagonal.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
TINY = 1e-100  # stands for a zero on the diagonal of a matrix whose largest entry is 1
CLOSE = 1e-5  # relative gap below which twisted vectors lose too much of their right angle
ROUNDS = 100


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): I - beta v v' turns x onto the first axis."""
    v = x.copy()
    top = np.abs(v).max(initial=0.0)
    if top == 0.0 or not np.any(v[1:]):
        return v, 0.0
    v /= top
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v, 2.0 / (v @ v)


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, float]]]:
    """(diagonal, superdiagonal, reflections from the right) of a square matrix."""
    a = matrix.astype(np.float64)
    size, right = len(a), []
    for k in range(size):
        v, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < size - 2:
            v, beta = _reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
                right.append((k + 1, v, beta))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform; None if the shift is above the smallest value. The third list has its pivots."""
    d = q[0] - shift
    new_q, new_e, pivots = [], [], [d]
    for k, off in enumerate(e):
        if d < 0.0:
            return None
        top = d + off
        ratio = q[k + 1] / top if top else 1.0
        new_q.append(top)
        new_e.append(off * ratio)
        d = d * ratio - shift
        pivots.append(d)
    if not d >= 0.0:
        return None
    return [*new_q, d], new_e, pivots


def _pair(q: list[float], off: float) -> tuple[float, float]:
    """Both values of a block of two."""
    total = q[0] + q[1] + off
    if total == 0.0:
        return 0.0, 0.0
    large = (total + math.sqrt((q[0] + off - q[1]) ** 2 + 4.0 * q[1] * off)) / 2.0
    return large, q[0] * (q[1] / large)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal matrix with squared entries q and e, any order.

    Two sweeps a round: one without shift, whose pivots are the inverses of the diagonal of
    the inverse, so the inverse of their inverses' sum is a bound from below; one with it.
    """
    found: list[float] = []
    work = [(list(q), list(e), 0.0, ROUNDS * len(q))]
    limit = (2.0 * EPS) ** 2
    while work:
        q, e, moved, left = work.pop()
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if len(q) == 2:
                found += [moved + x for x in _pair(q, e[0])]
                break
            if e[-1] <= limit * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next((k for k, off in enumerate(e) if off <= limit * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], moved, left))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if left <= 0:
                raise ArithmeticError("dqds does not converge")
            left -= 1
            if 2.25 * q[0] < q[-1]:  # small values belong at the end
                q.reverse()
                e.reverse()
            q, e, pivots = _sweep(q, e, 0.0)
            least = min(pivots)
            shift = 1.0 / sum(1.0 / p for p in pivots) if least > 0.0 else 0.0
            for part in (0.999999 * least, (1 - 1e-14) * shift, 0.9 * shift):
                if part > EPS * EPS * moved and (swept := _sweep(q, e, part)):
                    q, e, _ = swept
                    moved += part
                    break
    return found


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(unit vector, value) of B'B next to ``value``, for diagonal a and superdiagonal b."""
    size = len(a)
    d, low = (a * a).tolist(), (b / a[:-1]).tolist()
    z = np.ones(size)
    for _ in range(4):
        top, s = [], -value
        sums = [s]
        for k in range(size - 1):
            pivot = d[k] + s or EPS * EPS
            top.append(d[k] * low[k] / pivot)
            s = top[-1] * low[k] * s - value
            sums.append(s)
        bottom, p = [0.0] * (size - 1), d[-1] - value
        back = [p] * size
        for k in range(size - 2, -1, -1):
            pivot = d[k] * low[k] * low[k] + p or EPS * EPS
            ratio = d[k] / pivot
            bottom[k] = low[k] * ratio
            p = p * ratio - value
            back[k] = p
        gamma = np.array(sums) + np.array(back) + value
        twist = int(np.argmin(np.where(np.isfinite(gamma), np.abs(gamma), np.inf)))
        z = np.zeros(size)
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -top[k] * z[k + 1]
        for k in range(twist, size - 1):
            z[k + 1] = -bottom[k] * z[k]
        square = float(z @ z)
        step = float(gamma[twist]) / square
        z /= math.sqrt(square)
        if not abs(step) > 4 * EPS * value:
            break
        value += step
    return z, value


def _beside(a: np.ndarray, b: np.ndarray, value: float, known: list[np.ndarray]) -> np.ndarray:
    """One more vector of a cluster of values, at right angles to those known: inverse iteration."""
    size = len(a)
    product = np.diag(a * a + np.append(0.0, b * b)) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    shifted = product - value * (1 + 4 * EPS) * np.eye(size)
    z = np.random.default_rng(len(known)).standard_normal(size)
    for _ in range(4):
        for v in known * 2:
            z -= (v @ z) * v
        z /= np.linalg.norm(z)
        try:
            z = np.linalg.solve(shifted, z)
        except np.linalg.LinAlgError:  # singular to the last bit
            shifted += value * 16 * EPS * np.eye(size)
            z = np.linalg.solve(shifted, z)
        z /= np.linalg.norm(z)
    for v in known * 2:
        z -= (v @ z) * v
    return z / np.linalg.norm(z)


def right_singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, all of them and falling; vectors as columns, ``most`` at most).

    Vectors are given for values that are not zero to working precision.
    """
    size = len(matrix)
    scale = np.abs(matrix).max(initial=0.0)
    if scale == 0.0:
        return np.zeros(size), np.zeros((size, 0))
    order = np.argsort(-np.linalg.norm(matrix, axis=0), kind="stable")  # large columns first keep small values
    a, b, right = bidiagonalise(np.linalg.qr(matrix[:, order] / scale, "r"))
    a = np.where(np.abs(a) < TINY, TINY, a)
    cuts = np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:])))
    blocks = list(zip([0, *(cuts + 1)], [*(cuts + 1), size]))
    values = sorted(
        ((v, i) for i, (x, y) in enumerate(blocks) for v in dqds((a[x:y] ** 2).tolist(), (b[x : y - 1] ** 2).tolist())),
        reverse=True,
    )
    vectors: list[np.ndarray] = []
    near: dict[int, list[tuple[float, np.ndarray]]] = {}
    for value, i in values[:most]:
        if value <= (size * EPS) ** 2 * values[0][0]:
            break
        x, y = blocks[i]
        close = [z for v, z in near.get(i, []) if v - value <= CLOSE * v]
        z = _beside(a[x:y], b[x : y - 1], value, close) if close else twisted(a[x:y], b[x : y - 1], value)[0]
        near.setdefault(i, []).append((value, z))
        whole = np.zeros(size)
        whole[x:y] = z
        for at, v, beta in reversed(right):
            whole[at:] -= beta * (v @ whole[at:]) * v
        vectors.append(whole / np.linalg.norm(whole))
    out = np.zeros((size, len(vectors)))
    out[order] = np.array(vectors).T.reshape(size, -1)
    return np.array([v for v, _ in values]) * scale * scale, out
