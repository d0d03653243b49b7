"""Singular values and right singular vectors of a small square matrix: Householder bidiagonal form, differential quotient-difference
steps with shifts for the values, twisted factorisations for the vectors. Needs numpy only; runs inside a task.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
#: Values nearer to each other than this share are one cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
ROUNDS = 4


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """``v, beta, alpha`` with ``x - beta v (v.x) = alpha e1``."""
    scale = np.abs(x).max(initial=0.0)
    if scale == 0 or not x[1:].any():
        return np.zeros_like(x), 0.0, float(x[0]) if len(x) else 0.0
    v = x / scale
    norm = math.sqrt(v @ v)
    alpha = -math.copysign(norm, v[0])
    v[0] -= alpha
    return v, 2.0 / (v @ v), alpha * scale


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor V of an upper bidiagonal B, with ``matrix = U B V'`` for some orthogonal U."""
    a, d = np.array(matrix, dtype=float), matrix.shape[1]
    diagonal, above, v_all = np.zeros(d), np.zeros(max(d - 1, 0)), np.eye(d)
    for k in range(d):
        v, beta, diagonal[k] = reflector(a[k:, k].copy())
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k + 1 < d:
            v, beta, above[k] = reflector(a[k, k + 1 :].copy())
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            v_all[:, k + 1 :] -= beta * np.outer(v_all[:, k + 1 :] @ v, v)
    return diagonal, above, v_all


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential step with a shift, and the least of its divisors; negative if the shift was too large."""
    d = least = q[0] - shift
    new_q, new_e = [], []
    for above, below in zip(e, q[1:]):
        pivot = d + above
        new_q.append(pivot)
        if pivot > 0:
            ratio = below / pivot
            new_e.append(above * ratio)
            d = d * ratio - shift
        elif pivot == 0:  # both parts are 0: the array splits here
            new_e.append(0.0)
            d = below - shift
        else:
            return new_q, new_e, min(least, pivot, -math.ulp(0))
        least = min(least, d)
    new_q.append(d)
    return new_q, new_e, least


def pair_values(q0: float, e0: float, q1: float) -> tuple[float, float]:
    """Both eigenvalues of a piece of two, larger first, without loss of relative accuracy."""
    if q1 > q0:
        q0, q1 = q1, q0
    if e0 > 0:
        half = 0.5 * (q0 - q1 + e0)
        if half == 0:
            return q0, q1
        s = q1 * (e0 / half)
        s = q1 * (e0 / (half * (1 + math.sqrt(1 + s / half)))) if s <= half else q1 * (e0 / (half + math.sqrt(half) * math.sqrt(half + s)))
        large = q0 + (s + e0)
        return large, q1 * (q0 / large) if large else 0.0
    return q0, q1


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Squares of all singular values of a bidiagonal matrix, in falling order."""
    out: list[float] = []
    pieces = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    while pieces:
        q, e, moved = pieces.pop()
        for _ in range(200 * len(q) + 200):
            if not q:
                break
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            if len(q) == 2:
                out += [value + moved for value in pair_values(q[0], e[0], q[1])]
                break
            if e[-1] <= EPS * EPS * (moved + q[-1]):
                out.append(q.pop() + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                pieces.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:  # small values belong at the end
                q.reverse()
                e.reverse()
            shift = max(0.0, pair_values(q[-2] - min(q[-2], e[-2]), e[-1], q[-1])[1] * (1 - 4 * EPS))
            for attempt in range(60):
                new_q, new_e, least = qd_step(q, e, shift)
                if least >= 0:
                    break
                close = attempt < 2 and len(new_q) == len(q)
                shift = max(0.0, (shift + least) * (1 - 4 * EPS)) if close else shift * 0.25 if attempt < 30 else 0.0
            q, e, moved = new_q, new_e, moved + shift
        else:
            raise ArithmeticError("singular values did not settle")
    return sorted((max(v, 0.0) for v in out), reverse=True)


class Twisted:
    """Twisted factorisation of ``B'B - value``: from the top and from the bottom to the place where they meet best."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        floor = EPS * max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0), np.finfo(float).tiny)
        a = np.where(np.abs(diagonal) < floor, floor, diagonal)
        n = len(a)
        tiny = EPS * float(np.max(a * a))  # a pivot moved by so much is a rounding error of the matrix
        d, ratio_to = (a * a).tolist(), (above / a[:-1]).tolist()

        def safe(x: float) -> float:
            return x if abs(x) > tiny else math.copysign(tiny, x)

        s, self.top, self.down = [-value], [], []
        for i in range(n - 1):
            pivot = safe(s[i] + d[i])
            self.top.append(pivot)
            self.down.append(d[i] * ratio_to[i] / pivot)
            s.append(self.down[i] * ratio_to[i] * s[i] - value)
        p, self.bottom, self.up = [0.0] * n, [0.0] * n, [0.0] * (n - 1)
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            pivot = safe(d[i] * ratio_to[i] * ratio_to[i] + p[i + 1])
            self.bottom[i + 1] = pivot
            ratio = d[i] / pivot
            self.up[i] = ratio_to[i] * ratio
            p[i] = p[i + 1] * ratio - value
        met = [abs(x + y + value) for x, y in zip(s, p)]
        self.twist = min(range(n), key=lambda i: met[i] if met[i] == met[i] else math.inf)
        self.middle = safe(s[self.twist] + p[self.twist] + value)
        self.n = n

    def outwards(self, z: list[float]) -> np.ndarray:
        """The last part of a solution: from the twist to both ends."""
        for i in range(self.twist - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.twist, self.n - 1):
            z[i + 1] -= self.up[i] * z[i]
        out = np.array(z)
        out /= np.abs(out).max()
        return out / math.sqrt(out @ out)

    def vector(self) -> np.ndarray:
        z = [0.0] * self.n
        z[self.twist] = 1.0
        return self.outwards(z)

    def solve(self, right: np.ndarray) -> np.ndarray:
        """Direction of the solution for another right side."""
        y, r = right.tolist(), self.twist
        for i in range(r):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(self.n - 2, r - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        pivots = np.array([*self.top[:r], self.middle, *self.bottom[r + 1 :]])
        w = np.array(y) / pivots
        return self.outwards((w / np.abs(w).max()).tolist())


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Squares of the leading singular values that are not 0 to working precision, their right vectors (rows), and the sum of all."""
    diagonal, above, v = bidiagonal(matrix)
    values = squared_values(diagonal, above)
    total, d = math.fsum(values), len(values)
    kept = [x for x in values[:most] if x > (d * EPS) ** 2 * values[0]]
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(1)
    for j, value in enumerate(kept):
        near = [vectors[i] for i in range(j) if abs(kept[i] - value) <= CLUSTER * kept[i]]
        form = Twisted(diagonal, above, value)
        z = form.vector()
        for _ in range(ROUNDS if near else 1):
            for other in near * 2:
                z = z - (other @ z) * other
            size = math.sqrt(z @ z)
            z = z / size if size > 1e-8 else rng.standard_normal(d)
            z = form.solve(z)
        for other in vectors * 2:
            z = z - (other @ z) * other
        vectors.append(z / math.sqrt(z @ z))
    return np.array(kept), np.array(vectors).reshape(len(kept), d) @ v.T, total
