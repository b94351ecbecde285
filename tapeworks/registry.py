"""Named operators and queries."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Name -> callable; a name is taken once, an unknown one is an error."""

    def __init__(self) -> None:
        self._items: dict[str, Callable] = {}

    def register(self, name: str, item: Callable | None = None):
        """Registers item, or the function that it decorates."""
        if item is None:
            return lambda f: self.register(name, f)
        if name in self._items:
            raise KeyError(f"{name} is registered already")
        self._items[name] = item
        return item

    def create(self, name: str, *args, **kwargs):
        if name not in self._items:
            raise KeyError(f"unknown name {name}; there are {', '.join(sorted(self._items))}")
        return self._items[name](*args, **kwargs)

    def names(self) -> list[str]:
        return sorted(self._items)

    def items(self) -> dict[str, Callable]:
        return dict(self._items)


class Catalog:
    """Queries with the SQL that checks them."""

    def __init__(self) -> None:
        self.queries, self.sql = Registry(), {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries.register(name, f)
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
