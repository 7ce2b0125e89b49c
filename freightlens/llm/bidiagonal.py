"""Singular values and right singular vectors of a small matrix by its bidiagonal form.

Householder reflections turn the matrix into an upper bidiagonal one, B. The squares of its
singular values come from differential quotient-difference steps with shifts (dqds), which
use no subtraction but that of the shift and so find small values to full relative accuracy.
Each vector of B'B comes from the twisted factorisation of B'B - x: one factorisation from
the top, one from the bottom, joined where the residual is least. Vectors of values that
are close together are made orthogonal to each other.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Values with a smaller relative distance get orthogonalised vectors.
CLUSTER = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, right reflections as an orthogonal matrix) of a square matrix."""
    a = np.array(matrix, np.float64)
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        v = _reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= np.outer(v, 2 * (v @ a[k:, k:]))
        if k < n - 2:
            v = _reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= np.outer(2 * (a[k:, k + 1 :] @ v), v)
                right[:, k + 1 :] -= np.outer(2 * (right[:, k + 1 :] @ v), v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection turns ``x`` into a multiple of the first axis."""
    if len(x) < 2 or not np.abs(x[1:]).max(initial=0):
        return None
    v = x / np.abs(x).max()
    v[0] += np.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def squared_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, largest first."""
    out: list[float] = []
    cut = EPS * max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0)) * EPS
    begin = 0
    for i in range(len(diagonal)):
        if i == len(diagonal) - 1 or abs(upper[i]) <= cut:
            out += _dqds((diagonal[begin : i + 1] ** 2).tolist(), (upper[begin:i] ** 2).tolist())
            begin = i + 1
    return np.array(sorted(out, reverse=True))


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds step; the third result is the least of the intermediate values, below 0 if the shift was too large."""
    d = q[0] - shift
    new_q, new_e, least = [], [], d
    for i, below in enumerate(e):
        total = d + below
        ratio = q[i + 1] / total if total else 1.0
        new_q.append(total)
        new_e.append(below * ratio if total else q[i + 1])
        d = (d * ratio if total else 0.0) - shift
        if d < least:
            least = d
    new_q.append(d)
    return new_q, new_e, least


def _dqds(q: list[float], e: list[float]) -> list[float]:
    """The values of one unreduced block: shifts add up, and one value after the other splits off at the end."""
    found, moved = [], 0.0
    tiny = EPS * EPS
    while q:
        if len(q) == 1:
            found.append(moved + q.pop())
        elif e[-1] <= tiny * (moved + q[-1]) or e[-1] == 0:
            found.append(moved + q.pop())
            e.pop()
        else:
            # the smaller value of the last two rows, a bound that comes close as they split off
            half = (q[-2] + e[-1] + q[-1]) / 2
            product = q[-2] * q[-1]
            root = max(half * half - product, 0.0) ** 0.5
            shift = product / (half + root) if half + root else 0.0
            for attempt in (shift * (1 - 4 * EPS), shift / 4, 0.0):
                new_q, new_e, least = _step(q, e, attempt)
                if least >= 0:
                    break
            else:  # a zero shift on positive numbers cannot fail
                raise ArithmeticError("the numbers are not finite")
            q, e, moved = new_q, new_e, moved + attempt
            # where an inner number vanishes, the front is a block of its own
            for i in range(len(e) - 2, -1, -1):
                if e[i] <= tiny * (moved + min(q[i], q[i + 1])):
                    found += [moved + x for x in _dqds(q[: i + 1], e[:i])]
                    q, e = q[i + 1 :], e[i + 1 :]
                    break
    return found


def vectors(diagonal: np.ndarray, upper: np.ndarray, count: int) -> np.ndarray:
    """Unit eigenvectors of B'B as columns, for its ``count`` largest values, which are not to vanish."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    pairs, begin = [], 0
    for i in range(n):  # blocks, so that equal values of different ones get vectors of their own
        if i == n - 1 or abs(upper[i]) <= EPS * norm:
            block = slice(begin, i + 1)
            pairs += [(x, block) for x in squared_values(diagonal[block], upper[begin:i])]
            begin = i + 1
    pairs.sort(key=lambda p: -p[0])
    out = np.zeros((n, count))
    rng = np.random.default_rng(0)
    for k, (value, block) in enumerate(pairs[:count]):
        a, b = diagonal[block], upper[block.start : block.stop - 1]
        close = [j for j in range(k) if pairs[j][0] - value <= CLUSTER * value]

        def apart(z: np.ndarray, block: slice = block, close: list[int] = close) -> tuple[np.ndarray, float]:
            """(``z`` without its share in the vectors found of close values, of unit length; its size before)."""
            for _ in range(2):
                for j in close:
                    z = z - (out[block, j] @ z) * out[block, j]
            size = float(np.linalg.norm(z))
            return z / (size or 1.0), size

        z, size = apart(_twisted(a, b, value, norm))
        if size < 1e-3:  # the vector of the value before again
            z, _ = apart(rng.normal(size=len(a)))
        if close and len(a) > 1:
            for _ in range(4):  # inverse steps beside the vectors found
                z, _ = apart(_twisted(a, b, value, norm, z))
        out[block, k] = z
    return out


def _twisted(a: np.ndarray, b: np.ndarray, value: float, norm: float, start: np.ndarray | None = None) -> np.ndarray:
    """The vector of B'B = L D L' for ``value``; with ``start``, one step of inverse iteration from there."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    tiny = EPS * EPS * norm * norm
    safe = lambda x: x if abs(x) > tiny else tiny
    root = np.where(np.abs(a) > EPS * norm, a, EPS * norm)
    d, low = (root**2).tolist(), (b / root[:-1]).tolist()
    plus, l_plus, s = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    s[0] = -value
    for i in range(n - 1):
        plus[i] = safe(d[i] + s[i])
        l_plus[i] = low[i] * d[i] / plus[i]
        s[i + 1] = l_plus[i] * low[i] * s[i] - value
    plus[-1] = safe(d[-1] + s[-1])
    minus, u_minus, p = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        minus[i + 1] = safe(d[i] * low[i] ** 2 + p[i + 1])
        ratio = d[i] / minus[i + 1]
        u_minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = [s[i] + p[i] + value for i in range(n)]
    twist = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if start is None:
        z[twist] = 1.0
    else:
        z[:] = start
        for i in range(twist):
            z[i + 1] -= l_plus[i] * z[i]
        for i in range(n - 2, twist - 1, -1):
            z[i] -= u_minus[i] * z[i + 1]
        # the twist took both sides; the rest are the pivots of the two factorisations
        pivots = np.array([*plus[:twist], safe(gamma[twist]), *minus[twist + 1 :]])
        z /= pivots
    for i in range(twist - 1, -1, -1):
        z[i] -= l_plus[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] -= u_minus[i] * z[i]
    return z / np.linalg.norm(z)


def right_singular(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values, largest first; right vectors of at most ``most`` of them as columns).

    Values that vanish next to the largest, to working precision, get no vector.
    """
    scale = np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(len(matrix)), np.zeros((len(matrix), 0))
    diagonal, upper, right = bidiagonalise(matrix / scale)
    values = squared_values(diagonal, upper)
    rank = int((values > values[0] * (len(matrix) * EPS) ** 2).sum())
    return values * scale**2, right @ vectors(diagonal, upper, min(most, rank))
