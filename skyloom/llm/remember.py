"""A bounded memory of what pieces of text were turned into."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Remembered:
    """Two generations of entries; when the younger is full the older goes, so what is still asked for stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def of(self, keys: Iterable, make: Callable[[list], Iterable]) -> dict:
        """A table that has all ``keys``; ``make`` turns those not remembered into values, in order."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        if new := set(keys).difference(self.young):
            known = {k: self.old[k] for k in new if k in self.old}
            rest = list(new.difference(known))
            self.young.update(known)
            self.young.update(zip(rest, make(rest), strict=True))
        return self.young
