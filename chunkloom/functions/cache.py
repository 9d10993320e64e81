"""A cache bounded by bytes that forgets what was used longest ago."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable


class ByteCache:
    """Values with sizes; together they never take more than the bound. A value above the bound isn't kept."""

    def __init__(self, most: int) -> None:
        self.most, self.used = most, 0
        self._held: OrderedDict[Hashable, tuple[object, int]] = OrderedDict()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, key: Hashable) -> object | None:
        found = self._held.get(key)
        if found is None:
            return None
        self._held.move_to_end(key)
        return found[0]

    def put(self, key: Hashable, value: object, size: int) -> None:
        old = self._held.pop(key, None)
        if old:
            self.used -= old[1]
        if size > self.most:
            return
        self._held[key] = (value, size)
        self.used += size
        while self.used > self.most:
            _, (_, gone) = self._held.popitem(last=False)
            self.used -= gone
