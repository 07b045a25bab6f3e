"""Node and relationship tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .plans.parser import QueryError

SRC, DST = "_src", "_dst"


@dataclass(frozen=True)
class Table:
    """A node table (``key`` is its primary key) or a relationship table (from ``source`` to ``target``;
    its frame has ``_src`` and ``_dst``, the end nodes' keys, then the properties)."""

    name: str
    df: DataFrame
    key: str | None = None
    source: str | None = None
    target: str | None = None
    defaults: dict = field(default_factory=dict)
    comment: str = ""

    @property
    def is_node(self) -> bool:
        return self.key is not None

    @property
    def columns(self) -> list[T.StructField]:
        return [f for f in self.df.schema.fields if self.is_node or f.name not in (SRC, DST)]

    def column(self, name: str) -> T.StructField | None:
        return next((f for f in self.columns if f.name.lower() == name.lower()), None)

    def with_df(self, df: DataFrame) -> Table:
        return replace(self, df=df)


@dataclass(frozen=True)
class Lazy:
    """A table whose frame is made when a query first names it; its ends are known before."""

    name: str
    load: Callable[[], Table]
    key: str | None = None
    source: str | None = None
    target: str | None = None

    @property
    def is_node(self) -> bool:
        return self.key is not None


class Catalog:
    """Tables by case-insensitive name. Changing a table swaps its entry; a snapshot is a copy of the map."""

    def __init__(self):
        self.tables: dict[str, Table | Lazy] = {}
        self.version = 0

    def get(self, name: str) -> Table | None:
        t = self.tables.get(name.lower())
        if isinstance(t, Lazy):
            t = self.tables[name.lower()] = t.load()
        return t

    def need(self, name: str, node: bool | None = None) -> Table:
        t = self.get(name)
        if t is None or node is not None and t.is_node != node:
            raise QueryError(f"no {'' if node is None else 'node ' if node else 'relationship '}table {name}")
        return t

    def put(self, table: Table) -> None:
        self.tables[table.name.lower()] = table
        self.version += 1

    def drop(self, name: str) -> None:
        users = [t.name for t in self.rels(name)]
        if self.tables[name.lower()].is_node and users:
            raise QueryError(f"{name} is an end of {', '.join(users)}")
        del self.tables[name.lower()]
        self.version += 1

    def all(self) -> list[Table]:
        return [self.get(k) for k in list(self.tables)]

    def nodes(self) -> list[Table]:
        return [t for t in self.all() if t.is_node]

    def rels(self, node: str | None = None) -> list[Table]:
        """Relationship tables; with ``node`` only those that start or end at it."""
        names = [k for k, t in self.tables.items() if not t.is_node and (node is None or node.lower() in (t.source.lower(), t.target.lower()))]
        return [self.get(k) for k in names]
