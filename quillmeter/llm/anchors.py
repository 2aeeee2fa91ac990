"""Anchors of long strings: the least 32-byte gram of every window of LENGTH bytes.

A window's anchor depends on the window's bytes alone (the least gram hash, leftmost among
equals), so equal windows have equal anchors at equal offsets.
"""

from __future__ import annotations

import numpy as np

GRAM = 32

_rng = np.random.default_rng(19771216)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, x in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            t = np.full(size, np.uint64(x))
            t[0] = 1
            _powers[i] = np.multiply.accumulate(t)
    return _powers


def range_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes begin to end of each range, alike wherever they lie."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return _finish((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling: a string's halves are hashed first."""
    h, size = _BYTE[data], 1
    while size < GRAM:
        h = h[:-size] * _BASE + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
    return _finish(h)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each window of width values: a window is the end of one
    block of width values and the beginning of the next."""
    n = len(h)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = h
    grid = grid.reshape(blocks, width)
    place = np.arange(blocks * width).reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1)  # least value from the block's start to here,
    fresh = np.ones_like(grid, bool)
    fresh[:, 1:] = head[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).ravel()  # and its first place
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]  # least value from here to the block's end,
    far = blocks * width
    tail_at = np.minimum.accumulate(np.where(grid == tail, place, far)[:, ::-1], axis=1)[:, ::-1].ravel()  # and its first place
    first, last = slice(0, n - width + 1), slice(width - 1, n)
    return np.where(tail.ravel()[first] <= head.ravel()[last], tail_at[first], head_at[last])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of a text: position, hash, and the first and last start of the windows that have it."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(data)
    of = window_minima(h, length - GRAM + 1)
    begin = np.flatnonzero(np.diff(of, prepend=-1))  # a window's anchor never lies before its predecessor's
    return of[begin], h[of[begin]], begin, np.append(begin[1:], len(of)) - 1
