"""Hashes and bit counts over whole numpy arrays."""

from __future__ import annotations

import numpy as np

FACTOR = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]
_LANES = np.uint64(0x0101010101010101)


def mixed(a: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    a = (a ^ a >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ a >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ a >> np.uint64(33)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes (uint64) of data[start:end], bytes as the digits of a number to an odd base, mixed."""
    if len(_POWERS[0]) < len(data):
        for k, base in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            powers = np.full(len(data) * 5 // 4, base, np.uint64)
            powers[0] = 1
            _POWERS[k] = np.multiply.accumulate(powers)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][: len(data)], out=upto[1:])
    return mixed((upto[end] - upto[start]) * _POWERS[1][np.minimum(start, max(len(data) - 1, 0))])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes have each of the 64 bits set. Eight bits of a
    hash are summed at once in the bytes of a word, 255 hashes before they could overflow."""
    whole = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    whole[: len(hashes)] = hashes
    lanes = (whole[None, :] >> _SHIFTS) & _LANES
    sums = lanes.reshape(8, -1, 255).sum(axis=2).astype("<u8")
    return sums.view(np.uint8).reshape(8, -1, 8).sum(axis=1, dtype=np.int64).T.reshape(64)


def majorities(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of hashes (uint64; from its start, n of them, at least one; the runs fill the
    array) the bits (int64) that over half of them have."""
    counts = np.empty((len(starts), 8, 8), np.int64)
    for k in range(8):  # byte lanes: eight bits of a hash at once
        sums = np.add.reduceat(hashes >> np.uint64(k) & _LANES, starts)
        counts[:, :, k] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = counts.reshape(-1, 64)
    for k in np.flatnonzero(n > 255):
        counts[k] = bit_counts(hashes[starts[k] : starts[k] + n[k]])
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def once(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows without those that repeat the (key, v) before them."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return [c[new] for c in cols]
