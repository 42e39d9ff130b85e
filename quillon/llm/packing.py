"""Sorted 64-bit integers as few bytes: differences, byte planes apart, compressed; and ranges of them by partition."""

from __future__ import annotations

import zlib

import numpy as np


def packed(values: np.ndarray) -> bytes:
    """64-bit integers, byte planes apart so that small ones shrink."""
    return zlib.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def differences(values: np.ndarray) -> bytes:
    return packed(np.diff(values, prepend=np.uint64(0)))


def sums(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def edges_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the range of each of so many parts begins in sorted keys of so many bits, and the end."""
    which = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(parts + 1, dtype=np.uint64))
