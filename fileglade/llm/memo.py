"""A bounded memo for worker processes."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """Values of ``make`` by key: between one and two generations of ``limit`` keys are kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= 24:  # longer words hardly come again
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value
