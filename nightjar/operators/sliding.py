"""Order statistics of a sliding window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque


class SlidingMedian:
    """The last ``keep`` values, in arrival order and sorted, with their median and median absolute deviation.

    A value finds its place by bisection. The deviations from the median are two sorted runs, one to each side of it, so
    the middle one is found by bisection over how many come from the left run; nothing is sorted again.
    """

    def __init__(self, keep: int):
        self.keep, self.arrived, self.sorted = keep, deque(), []

    def __len__(self) -> int:
        return len(self.sorted)

    def push(self, value: float) -> None:
        if len(self.sorted) == self.keep:
            oldest = self.arrived.popleft()
            del self.sorted[bisect_left(self.sorted, oldest)]
        self.arrived.append(value)
        insort(self.sorted, value)

    def median(self) -> float:
        middle = len(self.sorted) // 2
        return self.sorted[middle] if len(self.sorted) % 2 else (self.sorted[middle - 1] + self.sorted[middle]) / 2

    def deviation(self, centre: float) -> float:
        """Median of the absolute deviations from ``centre``."""
        n, cut = len(self.sorted), bisect_right(self.sorted, centre)
        upper = self._nth_deviation(n // 2, centre, cut)
        return upper if n % 2 else (self._nth_deviation(n // 2 - 1, centre, cut) + upper) / 2

    def _nth_deviation(self, nth: int, centre: float, cut: int) -> float:
        """The deviation with ``nth`` smaller ones: values before ``cut`` lie at or below the centre, the rest above."""
        values, n = self.sorted, len(self.sorted)
        low, high = max(0, nth + 1 - (n - cut)), min(nth + 1, cut)
        while low < high:  # how many of the nth + 1 smallest come from the left
            left = (low + high) // 2
            if centre - values[cut - 1 - left] < values[cut + nth - left] - centre:
                low = left + 1
            else:
                high = left
        from_left = centre - values[cut - low] if low else float("-inf")
        from_right = values[cut + nth - low] - centre if nth >= low else float("-inf")
        return max(from_left, from_right)
