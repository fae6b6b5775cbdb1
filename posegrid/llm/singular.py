"""Singular values and right singular vectors of a small upper triangular matrix.

Householder reflections make the matrix bidiagonal; dqds (differential quotient-difference with
shifts) finds the squares of the singular values, each to high relative accuracy, without ever
forming R'R; twisted factorisations of B'B - s^2 give each direction by one division chain from the
place where the factorisations from both ends meet best.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Directions whose values agree to this relative gap are kept orthogonal by inverse iteration.
CLOSE = 1e-4


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal and superdiagonal of U'RV, and the reflectors of V (the k-th acts from k + 1 on)."""
    a = np.array(r, float)
    m = len(a)
    right: list[np.ndarray | None] = []

    def reflector(x: np.ndarray) -> tuple[np.ndarray | None, float]:
        size = np.linalg.norm(x)
        if size == 0 or len(x) == 1:
            return None, float(x[0])
        v = x / size
        head = -np.copysign(1.0, v[0])
        v[0] -= head
        return v / np.linalg.norm(v), head * size

    for k in range(m):
        v, top = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        a[k, k], a[k + 1 :, k] = top, 0
        if k + 1 < m:
            w, top = reflector(a[k, k + 1 :].copy())
            if w is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            a[k, k + 1], a[k, k + 2 :] = top, 0
            right.append(w)
    return a.diagonal().copy(), a.diagonal(1).copy(), right


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One dqds transform; the last value is the least d, below 0 if the shift was too large."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(max(0, n - 1))
    d = float(q[0]) - shift
    least = d
    for i in range(n - 1):
        new_q[i] = d + e[i]
        if new_q[i] <= 0:
            new_q[i:], new_e[i:] = 0, 0
            return new_q, new_e, min(least, -shift if shift else 0.0)
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least


def squared_values(diag: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The squares of the singular values of a bidiagonal matrix, falling, by dqds."""
    found: list[float] = []
    todo = [(diag.astype(float) ** 2, above.astype(float) ** 2, 0.0)]
    while todo:
        q, e, taken = todo.pop()
        if len(q) > 1 and not np.all(q > 0):
            # a zero on the diagonal: one zero-shift transform moves it to the end of its part
            zero = int(np.flatnonzero(q <= 0)[0])
            if zero < len(q) - 1:
                at, bulge = zero + 1, e[zero]
                q, e = q.copy(), e.copy()
                e[zero] = 0.0
                while bulge > 0 and at < len(q):  # rotate the row of the zero away
                    grown = q[at] + bulge
                    bulge_next = e[at] * bulge / grown if at < len(e) else 0.0
                    if at < len(e):
                        e[at] = e[at] * q[at] / grown
                    q[at], bulge, at = grown, bulge_next, at + 1
                todo += [(q[: zero + 1], e[:zero], taken), (q[zero + 1 :], e[zero + 1 :], taken)]
                continue
        shift, rounds = 0.0, 0
        while len(q):
            if len(q) == 1:
                found.append(max(float(q[0]) + taken, 0.0))
                break
            small = np.flatnonzero(e <= EPS**2 * (taken + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = int(small[-1]) + 1
                todo += [(q[:cut], e[: cut - 1], taken), (q[cut:], e[cut:], taken)]
                break
            rounds += 1
            if rounds > 60 * len(q) + 200:
                raise ArithmeticError("dqds did not settle")
            new_q, new_e, least = _step(q, e, shift)
            tries = 0
            while least < 0 and shift > 0:
                tries += 1
                shift = shift * 0.3 if tries < 4 else 0.0
                new_q, new_e, least = _step(q, e, shift)
            taken += shift
            q, e = new_q, new_e
            if q[0] < q[-1] * 0.5:  # graded the wrong way: from the other end it settles faster
                q, e = _turned(q, e)
                least = 0.0
            # a lower bound of the least value from the last rows: d less what its neighbour takes
            last = float(q[-1])
            shift = max(0.0, min(least, last) * (1 - min(1.0, np.sqrt(e[-1] / last))) * (1 - 1e-8)) if last > 0 else 0.0
    return np.sort(np.array(found))[::-1]


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same singular values with the array read from its other end."""
    return q[::-1].copy(), e[::-1].copy()


class Twisted:
    """B'B - value as N D N', twisted at the place where the remainder is least."""

    def __init__(self, diag: np.ndarray, above: np.ndarray, value: float):
        n = len(diag)
        d, low = diag**2, above / diag[:-1] if n > 1 else above
        tiny = EPS * EPS * max(float((d).max()), np.finfo(float).tiny)
        from_top, up = np.empty(n), np.empty(n)
        self.low, self.high = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
        top, bottom = np.empty(n), np.empty(n)
        s = -value
        for i in range(n):
            from_top[i] = s
            top[i] = d[i] + s if abs(d[i] + s) > tiny else -tiny
            if i < n - 1:
                self.low[i] = d[i] * low[i] / top[i]
                s = self.low[i] * low[i] * s - value
        p = d[n - 1] - value
        up[n - 1] = p
        bottom[n - 1] = p if abs(p) > tiny else -tiny
        for i in range(n - 2, -1, -1):
            below = d[i] * low[i] ** 2 + p
            below = below if abs(below) > tiny else -tiny
            bottom[i + 1] = below
            self.high[i] = low[i] * d[i] / below
            p = p * d[i] / below - value
            up[i] = p
        gamma = from_top + up + value
        self.at = k = int(np.abs(gamma).argmin())
        self.pivots = np.concatenate([top[:k], [gamma[k] if abs(gamma[k]) > tiny else tiny], bottom[k + 1 :]])

    def vector(self) -> np.ndarray:
        """The solution of N'z = e at the twist: the direction of the value, to rounding."""
        z = np.zeros(len(self.pivots))
        z[self.at] = 1.0
        for i in range(self.at - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(self.at, len(z) - 1):
            z[i + 1] = -self.high[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x of (B'B - value) x = b."""
        x, n, k = b.copy(), len(b), self.at
        for i in range(k):
            x[i + 1] -= self.low[i] * x[i]
        for i in range(n - 2, k - 1, -1):
            x[i] -= self.high[i] * x[i + 1]
        x /= self.pivots
        for i in range(k - 1, -1, -1):
            x[i] -= self.low[i] * x[i + 1]
        for i in range(k, n - 1):
            x[i + 1] -= self.high[i] * x[i]
        return x


def right_directions(r: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The squared singular values of r that differ from 0 in double precision, falling, at most
    `most` of them, and their right singular vectors as columns, the largest entry positive."""
    m = len(r)
    size = float(np.abs(r).max(initial=0.0))
    if not m or not size:
        return np.zeros(0), np.zeros((m, 0))
    diag, above, right = bidiagonal(np.asarray(r, float) / size)
    norm = max(float(np.abs(diag).max()), float(np.abs(above).max(initial=0.0)))
    above[np.abs(above) <= EPS * norm * 1e-3] = 0.0
    # a zero diagonal entry has no quotient; one far under rounding stands for it
    diag = np.where(np.abs(diag) <= EPS * norm * 1e-6, EPS * norm * 1e-6, diag)
    parts, begin = [], 0
    for i in [*np.flatnonzero(above == 0) + 1, m]:
        parts.append((begin, int(i)))
        begin = int(i)
    all_values = [(v, a, b) for a, b in parts for v in squared_values(diag[a:b], above[a : b - 1])]
    all_values.sort(key=lambda x: -x[0])
    floor = (m * EPS) ** 2 * all_values[0][0]
    taken = [x for x in all_values if x[0] > floor][:most]
    out: list[np.ndarray] = []
    rng = np.random.default_rng(13)
    for k, (value, a, b) in enumerate(taken):
        near = [out[j] for j in range(k) if taken[j][1:] == (a, b) and taken[j][0] - value <= CLOSE * value]
        twist = Twisted(diag[a:b], above[a : b - 1], value)
        z = np.zeros(m)
        z[a:b] = twist.vector()
        if near:
            basis = np.array(near)
            x = rng.standard_normal(b - a)
            for _ in range(4):
                x = x - basis[:, a:b].T @ (basis[:, a:b] @ x)
                x = twist.solve(x / np.linalg.norm(x))
                x /= np.linalg.norm(x)
            for _ in range(2):
                x -= basis[:, a:b].T @ (basis[:, a:b] @ x)
            z[a:b] = x / np.linalg.norm(x)
        out.append(z)
    v = np.array(out).T
    for k in range(len(right) - 1, -1, -1):
        if right[k] is not None:
            v[k + 1 :] -= 2 * np.outer(right[k], right[k] @ v[k + 1 :])
    v *= np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
    return np.array([x[0] for x in taken]) * size**2, v
