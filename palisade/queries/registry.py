"""A module's queries and their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if oracle:
                self.oracle[f.__name__] = oracle
            return f

        return add
