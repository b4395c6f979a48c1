"""Polynomial hashes of byte ranges, for whole arrays at once.

``prefix[i]`` is the sum of ``(byte[j] + 1) * M**j`` for j < i, modulo 2**64. As M is odd it
has an inverse, so the hash of any range is a difference of two prefixes times a power
of that inverse, and equal ranges have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

#: An odd multiplier, its inverse modulo 2**64, and two odd mixing factors.
M = 0x9E3779B97F4A7C15
M_INV = pow(M, -1, 1 << 64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)``, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(M, len(data)), out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end)."""
    return (pre[end] - pre[start]) * powers(M_INV, len(pre))[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the strong high bits of a polynomial hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def hold() -> None:
    """Lets the C library keep freed blocks of up to 64 MB for the next arrays until :func:`tidy`.

    Otherwise each large array is mapped, zeroed and unmapped by the kernel, which costs as
    much as the arithmetic on it.
    """
    import ctypes

    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 64 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def tidy() -> None:
    """Hands freed memory back at the end of a task; a worker process outlives it."""
    import ctypes
    import gc

    _powers.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass
