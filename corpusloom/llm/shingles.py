"""Word shingles of many texts at once: numpy over one byte buffer, no loop over words."""

from __future__ import annotations

import numpy as np

_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(97, 123))] = True
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash): the distinct 64-bit shingle hashes of each text, sorted by owner and hash.

    Words are the maximal runs of [a-z0-9] of the lower-cased text. Null and short texts have none.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = _WORD[buffer]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # a word's hash is the wrapped sum of mixed (byte, place in word) values
    length = stop - start
    flat = np.flatnonzero(inside)
    place = flat - np.repeat(start, length)
    value = mix((buffer[flat].astype(np.uint64) + np.uint64(1)) * _BASE + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    word = mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))
    owner = np.searchsorted(ends, start, side="right")
    n = len(word) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    same = owner[:n] == owner[width - 1 :]
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h * _BASE + word[k : k + n])
    owner, h = owner[:n][same], h[same]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[keep], h[keep]
