"""Sobol points with a random digital shift, in numpy and as SQL text.

Direction numbers follow from a rule: the primitive polynomials over two elements in order of degree and value, and odd
starting numbers from a seeded generator. A point is the exclusive or of the direction numbers at the set bits of its
index's Gray code, moved by a shift that is a random number a coordinate.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np

BITS = 32


def primitive_polynomials() -> Iterator[tuple[int, int]]:
    """Degree and coefficients (highest first, as bits) of each primitive polynomial: those that x generates all residues of."""
    for degree in itertools.count(1):
        for p in range((1 << degree) + 1, 2 << degree, 2):
            x, order = 2 ^ p if degree == 1 else 2, 1
            while x != 1 and order < 1 << degree:
                x <<= 1
                x ^= p if x >> degree else 0
                order += 1
            if order == (1 << degree) - 1:
                yield degree, p


@functools.lru_cache(maxsize=8)
def directions(d: int) -> np.ndarray:
    """d x BITS numbers of BITS bits; the first coordinate is the radical inverse."""
    rng = np.random.default_rng(1729)
    out = np.zeros((d, BITS), np.uint64)
    out[0] = [1 << (BITS - 1 - k) for k in range(BITS)]
    for j, (degree, p) in zip(range(1, d), primitive_polynomials(), strict=False):
        m = [2 * int(rng.integers(1 << k)) + 1 for k in range(degree)]
        for k in range(degree, BITS):
            new = m[k - degree]
            for i in range(1, degree + 1):
                if p >> (degree - i) & 1:
                    new ^= m[k - i] << i
            m.append(new)
        out[j] = [x << (BITS - 1 - k) for k, x in enumerate(m)]
    return out


def shifts(d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << BITS, d, dtype=np.uint64)


def sobol(n: int, d: int, seed: int = 0) -> np.ndarray:
    """The first n points in the open unit cube. n is best a power of 2."""
    k = np.arange(n, dtype=np.uint64)
    gray = k ^ (k >> np.uint64(1))
    out = np.tile(shifts(d, seed), (n, 1))
    for b in range(max(1, int(n - 1).bit_length())):
        out ^= np.where((gray >> np.uint64(b) & np.uint64(1))[:, None] == 1, directions(d)[:, b], np.uint64(0))
    return (out + 0.5) / 2.0**BITS


def sobol_sql(k: str, n: int, d: int, j: int, seed: int, xor: str = "{} ^ {}") -> str:
    """Coordinate j of point k (an expression below n), the same as sobol(n, d, seed). xor: how the engine writes it."""
    gray = "(" + xor.format(k, f"CAST(floor({k} / 2) AS BIGINT)") + ")"
    out = str(int(shifts(d, seed)[j]))
    for b in range(max(1, int(n - 1).bit_length())):
        out = "(" + xor.format(out, f"CASE WHEN CAST(floor({gray} / {1 << b}) AS BIGINT) % 2 = 1 THEN {int(directions(d)[j, b])} ELSE 0 END") + ")"
    return f"(({out} + 5.0e-1) / {2.0**BITS:.1f}e0)"
