"""A bounded cache for values of a skewed stream of keys."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class TwoGenerations(dict):
    """A dict that computes missing values, of at most ``2 * most`` entries.

    When the young generation is full it becomes the old one; an old entry that is asked for
    again moves to the young one. Frequent keys therefore stay, at the cost of a plain lookup.
    """

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self._compute, self._most, self._old = compute, most, {}

    def __missing__(self, key: Hashable):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value
