"""Names for exchangeable parts: extraction strategies, storage, log filters."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """Parts by lower-case name, in the order of registration; a name that is registered again gets the new part."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._parts: dict[str, tuple[Any, str, Callable[[str], bool] | None]] = {}

    def register(self, name: str, part: Any, description: str = "", supports: Callable[[str], bool] | None = None) -> None:
        self._parts[name.lower()] = (part, description, supports)

    def names(self) -> list[str]:
        return list(self._parts)

    def get(self, name: str) -> Any:
        """The part of that name, or else the first that supports it."""
        if name.lower() in self._parts:
            return self._parts[name.lower()][0]
        for part, _, supports in self._parts.values():
            if supports and supports(name):
                return part
        raise ValueError(f"no {self.kind} for {name!r}; there are {', '.join(sorted(self._parts)) or 'none'}")

    def describe(self) -> list[dict[str, str]]:
        return [{"name": n, "description": d} for n, (_, d, _) in self._parts.items()]
