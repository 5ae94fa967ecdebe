"""Anchors: content-chosen places that bring equal strings of a given length together."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE_BITS = np.uint64(24)
PART = 1 << 21  # bytes looked at together


def gram_bytes(length: int) -> int:
    """Bytes an anchor's hash covers: the largest power of two up to a third of ``length``."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all ``gram``-byte strings of ``data``, built by doubling their length."""
    value = (data.astype(np.uint64) + np.uint64(1)) * _A
    value ^= value >> np.uint64(32)
    span = 1
    while span < gram:
        value = value[:-span] * _B + value[span:]
        value ^= value >> np.uint64(29)
        value *= _A
        span *= 2
    return value


def _sliding_least(value: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: block-wise minima from both sides."""
    n = len(value)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = value
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    last = n - width + 1
    return np.minimum(behind[:last], ahead[width - 1:width - 1 + last])


def contexts(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, first, last)`` of the anchors of one document's bytes.

    Every string of ``length`` bytes chooses the gram (``gram_bytes``) inside it with the least
    hash, the leftmost of equals.  Strings starting at ``first`` to ``last`` chose the same
    one.  Equal strings choose alike wherever they stand, so a string whose anchor's hash
    occurs once in the corpus occurs once.
    """
    gram, found = gram_bytes(length), []
    width = length - gram + 1
    for a in range(0, max(0, len(data) - length + 1), PART):
        part = data[a:a + PART + length - 1]
        hashed = gram_hashes(part, gram)
        place = np.arange(len(hashed), dtype=np.uint64)
        least = _sliding_least((hashed >> _PLACE_BITS) << _PLACE_BITS | place, width)
        place = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        begins = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(begins[1:], len(place))
        found.append((hashed[place[begins]], begins + a, ends - 1 + a))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))
