"""Vectorised 64-bit hashes of byte strings, words and windows (numpy, modulo 2**64)."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0xD1342543DE82EF95  # odd, so that its powers can be inverted modulo 2**64
_STEP_INV = pow(_STEP, -1, 1 << 64)

#: White space of the contracts: 0x20 and 0x09 to 0x0D. No byte of a multi-byte UTF-8 character is among them.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the output (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[0]
    x = (x ^ (x >> np.uint64(27))) * _MUL[1]
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Powers:
    """Powers of the step and of its inverse, grown on demand and reused between documents."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, step in (("up", _STEP), ("down", _STEP_INV)):
                grown = np.full(size, step, np.uint64)
                grown[0] = 1
                setattr(self, name, np.multiply.accumulate(grown))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """P such that (P[j] - P[i]) * step**-i depends on data[i:j] alone."""
    return sums_of(_BYTE[data])


def byte_values(data: np.ndarray) -> np.ndarray:
    """The hashes of single bytes that prefix_sums adds up."""
    return _BYTE[data]


def sums_of(values: np.ndarray) -> np.ndarray:
    """prefix_sums of a sequence of hashes."""
    up, _ = POWERS.upto(max(1, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal strings."""
    _, down = POWERS.upto(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hashes of all windows of the width, from the first start on."""
    _, down = POWERS.upto(len(sums))
    out = sums[width:] - sums[:-width]
    out *= down[: len(out)]
    out += np.full(1, width, np.uint64) * _ODD  # arrays wrap around, single numbers warn
    return mix(out)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """span_hashes of words, with sums over about a piece of the data at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, "right")))
        first, last = starts[at], ends[upto - 1]
        out[at:upto] = span_hashes(prefix_sums(data[first:last]), starts[at:upto] - first, ends[at:upto] - first)
        at = upto
    return out


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes, element by element."""
    total = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        total += part * mix(np.array([k + 1], np.uint64))[0]
    return mix(total + mix(np.array([len(parts)], np.uint64)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def words_of(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and for each text the index of its first word (with one more at the end)."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    if lower:
        joined = lower_ascii(joined)
    start, end = word_spans(joined)
    hashes = span_hashes(prefix_sums(joined), start, end)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    return hashes, np.searchsorted(start, begins)
