"""Places, hashes and spelling classes of the words of many texts, from UTF-8 bytes. No Python object is made per word."""

from __future__ import annotations

import numpy as np

from tessella.llm.wordhash import mix, powers

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

#: Number of spelling classes.
CLASSES = 64
_KIND = np.zeros((3, 256), np.int32)  # digit, other ASCII sign, byte beyond ASCII
_KIND[0, 48:58] = 1
_KIND[1, [b for b in range(128) if not chr(b).isalnum()]] = 1
_KIND[2, 128:] = 1
_OPEN = np.isin(np.arange(256), [ord(c) for c in "aeiou"])


def byte_set(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each longest run of bytes that aren't ``outside``, within the texts that offsets mark."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~outside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    return np.flatnonzero(inside & (~before | cut[:n])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def spelling(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class (0 to 63) of each span: holds digits, signs, bytes beyond ASCII; length in four steps; ends in a vowel."""
    out = np.zeros(len(starts), np.int64)
    total = np.zeros(len(data) + 1, np.int32)
    for bit, kind in enumerate(_KIND):
        np.cumsum(kind[data], out=total[1:])
        out |= (total[ends] > total[starts]).astype(np.int64) << bit
    length = ends - starts
    out |= ((length > 4).astype(np.int64) + (length > 7) + (length > 10)) << 3
    return out | (_OPEN[data[ends - 1]].astype(np.int64) << 5 if len(starts) else 0)
