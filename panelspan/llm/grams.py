"""Hashed character n-grams of UTF-8 text, many documents at a time."""

from __future__ import annotations

import numpy as np

GAP = 8         # zero bytes between documents, so that no n-gram of up to 8 bytes spans two of them


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (A-Z in lower case) with gaps between, and where each text's part begins; the last bound is the end."""
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) + GAP for p in parts])]).astype(np.int64)
    return np.frombuffer(bytes(GAP).join(parts) + bytes(GAP), np.uint8), bounds


def hashed(data: np.ndarray, orders: tuple[int, ...], bits: int):
    """Yields the bucket of the n-gram that starts at each byte, for each order."""
    wide = data.astype(np.uint32)
    h = np.zeros(len(wide), np.uint32)
    for n in range(1, max(orders) + 1):
        h = h[:len(wide) - n + 1] * np.uint32(0x01000193) + wide[n - 1:] + np.uint32(1)
        if n in orders:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            yield (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(32 - bits)


def distinct(texts: list[str], orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Sorted distinct buckets of each text."""
    data, bounds = joined(texts)
    keys = [(np.searchsorted(bounds, np.arange(len(h)), "right") - 1 << bits) + h for h in hashed(data, orders, bits)]
    keys = np.unique(np.concatenate(keys))
    cut = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << bits)
    return [(keys[a:b] & ((1 << bits) - 1)).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def weighed(texts: list[str], weights: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Sum of the weights of the distinct buckets of each text."""
    data, bounds = joined(texts)
    found = []
    for h in hashed(data, orders, bits):
        at = np.flatnonzero(weights[h])
        found.append((np.searchsorted(bounds, at, "right") - 1 << bits) + h[at])
    keys = np.unique(np.concatenate(found))
    return np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], len(texts))


def totals(texts: list[str], tables: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Sum over all n-grams of one order of the rows of ``tables`` (buckets x columns), for each text."""
    data, bounds = joined(texts)
    h = next(hashed(data, (order,), bits))
    sums = np.empty((len(texts), tables.shape[1]))
    for k in range(tables.shape[1]):
        run = np.concatenate([[0.0], np.cumsum(tables[h, k], dtype=np.float64)])
        last = np.maximum(bounds[1:] - GAP - order + 1, bounds[:-1])     # texts shorter than the order have none
        sums[:, k] = run[last] - run[bounds[:-1]]
    return sums


def word_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of words between ASCII white space (and the gaps) in each document."""
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    begins = ~blank & np.concatenate([[True], blank[:-1]])
    return np.diff(np.concatenate([[0], np.cumsum(begins)])[bounds])
