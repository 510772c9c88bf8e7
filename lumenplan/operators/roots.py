"""Roots and least values of many rows at once: numpy loops over the arrays of one Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Microseconds to which an instant is refined.
SECOND = 1_000_000


def bisect_edges(low: np.ndarray, high: np.ndarray, state: Callable[[np.ndarray], np.ndarray], steps: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Both ends, a second apart at most, of the half intervals in which ``state`` leaves its value at ``low``.

    ``state`` takes an instant per row in microseconds and gives any comparable value per row: a sign, or
    inside and outside.
    """
    first = state(low)
    for _ in range(steps):
        middle = (low + high) // 2
        go, same = high - low > SECOND, state(middle) == first
        low, high = np.where(go & same, middle, low), np.where(go & ~same, middle, high)
    return low, high


def least_between(low: np.ndarray, high: np.ndarray, value: Callable[[np.ndarray], np.ndarray], steps: int = 32) -> np.ndarray:
    """The middle of what ternary search leaves of each interval, a second at most; of equal thirds the upper end moves."""
    for _ in range(steps):
        third = (high - low) // 3
        left, right = low + third, high - third
        go, lower = high - low > SECOND, value(left) <= value(right)
        low, high = np.where(go & ~lower, left, low), np.where(go & lower, right, high)
    return (low + high) // 2
