"""Requests to an embedding provider that has limits: how many texts at once, how long together, how long alone.

A request that is refused as too long is cut into halves, and these again; a text that is refused alone is tried again with its
first half. So a text that fits has the vector that it would have by itself, whatever it was sent along with, and one long
text costs its neighbours nothing but a second request.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence


class TooLong(Exception):
    """What a provider raises if a request is longer than it takes."""


class BadReply(ValueError):
    """A reply that doesn't fit its request."""


def ordered(reply: Sequence, asked: int, width: int) -> list[list[float]]:
    """The vectors of a reply in order of the request. It is a list of vectors, or of (index, vector) in any order; a wrong number,
    an index that comes twice or isn't one, another width and numbers that aren't finite are errors."""
    pairs = [(int(r[0]), r[1]) if len(r) == 2 and isinstance(r[1], (list, tuple)) else (i, r) for i, r in enumerate(reply)]
    if len(pairs) != asked or sorted(i for i, _ in pairs) != list(range(asked)):
        raise BadReply(f"{len(pairs)} vectors at places {sorted(i for i, _ in pairs)[:5]}...; {asked} were asked for")
    out = [[float(x) for x in v] for _, v in sorted(pairs, key=lambda p: p[0])]
    if any(len(v) != width or not all(map(math.isfinite, v)) for v in out):
        raise BadReply(f"a vector isn't {width} finite numbers")
    return out


def embedded(texts: Sequence[str], call: Callable[[list[str]], Sequence], width: int, most: int, shortest: int = 1) -> list[list[float]]:
    """A vector for each text, from requests of at most ``most`` texts; a text is halved down to ``shortest`` characters before its refusal is an error."""
    out: list[list[float] | None] = [None] * len(texts)
    waiting = [(list(range(lo, min(lo + most, len(texts)))), 0) for lo in range(0, len(texts), most)][::-1]
    while waiting:
        places, halvings = waiting.pop()
        request = [texts[i][: len(texts[i]) >> halvings] for i in places]
        try:
            found = ordered(call(request), len(request), width)
        except TooLong:
            if len(places) > 1:
                middle = len(places) // 2
                waiting += [(places[middle:], 0), (places[:middle], 0)]
            elif len(request[0]) >> 1 >= shortest:
                waiting.append((places, halvings + 1))
            else:
                raise
            continue
        for i, vector in zip(places, found, strict=True):
            out[i] = vector
    return out


class Limited:
    """A provider for tests and measuring: a text's length and first character, with limits on texts, on characters together and on characters alone."""

    name, dim = "limited", 2

    def __init__(self, batch: int = 8, alone: int = 500, together: int = 2000):
        self.batch, self.alone, self.together = batch, alone, together

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]:
        if len(texts) > self.batch:
            raise ValueError("too many texts")
        if sum(map(len, texts)) > self.together or max(map(len, texts), default=0) > self.alone:
            raise TooLong
        return [(i, [float(len(t)), float(ord(t[0])) if t else -1.0]) for i, t in reversed(list(enumerate(texts)))]
