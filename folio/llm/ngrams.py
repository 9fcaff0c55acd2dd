"""Hashed character n-grams and words of a text as numpy arrays, for the trained operators."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letter_table() -> np.ndarray:
    """Whether a code point is a letter, up to U+FFFF; what lies beyond counts as one."""
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


_letters: np.ndarray | None = None


def is_letter(cp: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = letter_table()
    return _letters[np.minimum(cp, 0xFFFF)] | (cp > 0xFFFF)


def gram_hashes(cp: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each size, the hash (below 2**bits) of the n-gram that begins at each place."""
    out, h = [], cp.astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - bits)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(cp) < n:
                break
            h = h[:-1] * np.uint64(1_000_003) + (cp[n - 1 :].astype(np.uint64) + np.uint64(1))
        if n in sizes:
            out.append(((h * np.uint64(n) * _MULT) >> shift).astype(np.int64))
    return out


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    """base**i modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[:1] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out
