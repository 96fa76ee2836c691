"""A bounded cache of encoded pieces of text, one for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: White space as Unicode's White_Space property has it, inside a character class of a
#: pattern. (Python's own class also holds U+001C to U+001F.)
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class WorkerCache(dict):
    """piece -> its encoding. ``encode_many`` gets the pieces that are missing, many
    at a time. Holds ``limit`` pieces between batches at most (it is emptied when it
    has more) and none of over ``longest`` characters, so its memory is bounded."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable], limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.encode_many, self.limit, self.longest = encode_many, limit, longest

    def ready(self, lists: Iterable[Iterable[str]], known: dict | None = None) -> None:
        """Encodes the pieces of these lists that neither this cache nor ``known`` has."""
        if len(self) > self.limit:
            self.clear()
        wanted: set[str] = set().union(*lists)
        wanted.difference_update(self)
        if known:
            wanted.difference_update(known)
        missing = list(wanted)
        self._long = [p for p in missing if len(p) > self.longest]
        self.update(zip(missing, self.encode_many(missing), strict=True) if missing else ())

    def done(self) -> list[str]:
        """Drops the long pieces of the last batch and returns them."""
        for p in self._long:
            self.pop(p, None)
        return self._long
