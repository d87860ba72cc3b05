"""Output tables computed on first access.

Change operators that return several tables (some needing eager helper
jobs such as id assignment) return a ``Deferred`` mapping, so a caller
that reads only the rejects, or only one table, runs only that work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame


class Deferred(Mapping):
    def __init__(self, factories: dict[str, Callable[[], DataFrame]]):
        self._factories = {k: cache(f) for k, f in factories.items()}

    def __getitem__(self, key: str) -> DataFrame:
        return self._factories[key]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._factories)

    def __len__(self) -> int:
        return len(self._factories)


def once(fn: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """Memoize a shared step of several deferred outputs."""
    return cache(fn)
