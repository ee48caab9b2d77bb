"""Hashes of whole texts with numpy: no Python step for a character or a word."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, MIX_1, MIX_2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (two rounds of multiply and shift)."""
    x = (x ^ (x >> U(30))) * MIX_1
    x = (x ^ (x >> U(27))) * MIX_2
    return x ^ (x >> U(31))


def codes(text: str) -> np.ndarray:
    """Code points; a lone surrogate counts as itself."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


#: Scattered values of the common code points.
_LETTERS = mix((np.arange(0x3000, dtype=U) + U(1)) * BASE)


def letters(c: np.ndarray) -> np.ndarray:
    """A scattered 64-bit value for each code point."""
    if len(c) and int(c.max()) >= len(_LETTERS):
        return mix((c.astype(U) + U(1)) * BASE)
    return _LETTERS[c]
