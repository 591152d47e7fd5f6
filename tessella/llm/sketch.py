"""SetSketch: registers of exponentially spaced, truncated minima, and the joint likelihood of two of them.

Register i of a set holds clip(floor(1 - log_b x_i), 0, q + 1), x_i the smallest of its elements'
exponential values of rate 1. Registers of a union are the larger of the two: sketches merge.
"""

from __future__ import annotations

import numpy as np

from tessella.llm.words import seeded

SPACING = 1.2  # b: the ratio between register steps
TOP = 254  # q + 1: the largest register value


class Sketcher:
    def __init__(self, registers: int, seed: int = 1) -> None:
        self.a = (seeded(registers, 2 * seed) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.c = (seeded(registers, 2 * seed + 1) >> np.uint64(32)).astype(np.uint32)

    def minima(self, elements: np.ndarray) -> np.ndarray:
        """For each register, the smallest 32-bit value over the elements (64-bit hashes)."""
        low, short = np.full(len(self.a), 2**32 - 1, np.uint32), (elements >> np.uint64(32)).astype(np.uint32)
        for lo in range(0, len(short), 4096):
            low = np.minimum(low, (self.a[:, None] * short[None, lo : lo + 4096] + self.c[:, None]).min(axis=1))
        return low

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        exponential = -np.log1p(-(self.minima(elements).astype(np.float64) + 0.5) / 2.0**32)
        return np.clip(np.floor(1 - np.log(exponential) / np.log(SPACING)), 0, TOP).astype(np.uint8)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(one, other)


def greater(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set exceeds the other's, x the first's share that is its own alone."""
    return -np.log1p(-x * (SPACING - 1) / SPACING) / np.log(SPACING)


def jaccard(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, steps: int = 26) -> np.ndarray:
    """Maximum-likelihood similarity of row pairs of sketches, given both sets' sizes.

    The log-likelihood D+ log p(u - vJ) + D- log p(v - uJ) + D0 log(1 - both) is concave in J:
    golden-section search between 0 and min(u/v, v/u).
    """
    up, down = (one > other).sum(axis=-1), (one < other).sum(axis=-1)
    same = one.shape[-1] - up - down
    u = n_one / (n_one + n_other)
    v = 1 - u

    def loss(j: np.ndarray) -> np.ndarray:
        p, q = greater(np.maximum(u - v * j, 0)), greater(np.maximum(v - u * j, 0))
        return -(up * np.log(p + 1e-12) + down * np.log(q + 1e-12) + same * np.log(np.maximum(1 - p - q, 1e-12)))

    lo, hi, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(steps):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = loss(a) < loss(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2
