"""Hashed character n-grams as numpy arrays; the classifiers share them."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint32(0x01000193)


def code_points(text: str) -> np.ndarray:
    """Lower-cased text with a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A 32-bit hash of each run of `order` characters."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    out = np.full(n, order, np.uint32)
    for k in range(order):
        out = (out ^ points[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint32(15)
    return out * np.uint32(0x9E3779B1)


def text_hashes(text: str, orders: tuple[int, ...]) -> np.ndarray:
    points = code_points(text)
    return np.concatenate([gram_hashes(points, n) for n in orders])
