"""Hashes of many numbers at once: the draws that SQL and ``stats.uniform`` take from MD5, over arrays."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32).reshape(64, 1)
_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, dtype=np.uint32).reshape(64, 1)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32).reshape(4, 1)
_AT = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _mixed(state: list[np.ndarray], words: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """State after so many rounds over a block; words that are the same for all messages are arrays of one."""
    a, b, c, d = state
    for i in range(rounds):
        f = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
        f = f + a + (words[_AT[i]] + _SINES[i])
        a, b, c, d = d, b + ((f << _TURNS[i]) | (f >> (32 - _TURNS[i]))), b, c
    return [a, b, c, d]


@lru_cache(maxsize=16)
def _digits(low: int, high: int, size: int, shift: int) -> list[np.ndarray]:
    """The decimal digits of numbers of ``size`` digits as little-endian words, the first ``shift`` bytes into its word."""
    numbers = np.arange(low, high)
    out = [np.zeros(high - low, dtype=np.uint32) for _ in range(-(-(shift + size) // 4))]
    for j in range(size):
        word, byte = divmod(shift + j, 4)
        out[word] |= ((48 + numbers // 10 ** (size - 1 - j) % 10) << (8 * byte)).astype(np.uint32)
    return out


def _heads(prefix: bytes, low: int, high: int, size: int) -> np.ndarray:
    length = len(prefix) + size
    blank = prefix + bytes(size) + b"\x80" + bytes((55 - length) % 64) + (8 * length).to_bytes(8, "little")
    words = list(np.frombuffer(blank, dtype="<u4").astype(np.uint32).reshape(-1, 1))
    for k, w in enumerate(_digits(low, high, size, len(prefix) % 4), len(prefix) // 4):
        words[k] = words[k] | w
    state = list(_START)
    for k in range(0, len(words) - 16, 16):
        state = [s + x for s, x in zip(state, _mixed(state, words[k : k + 16], 64), strict=True)]
    return (state[0] + _mixed(state, words[-16:], 61)[1]).byteswap()  # the first word is ready three rounds before the last


def md5_heads(prefix: bytes, low: int, high: int) -> np.ndarray:
    """The first eight hexadecimal digits, as numbers, of the MD5 of ``prefix`` followed by each number from ``low`` to before ``high``."""
    cuts = [low, *(10**k for k in range(1, 19) if low < 10**k < high), high]
    return np.concatenate([_heads(prefix, a, b, len(str(a))) for a, b in zip(cuts, cuts[1:], strict=False) if a < b] or [np.zeros(0, np.uint32)])
