"""A graph as DataFrames: sources of nodes and edges, and the view queries read.

A node source has ``vid``, its property columns (``p_<key>``) and, unless all its rows carry the same
labels, a column ``labels``. An edge source has ``src``, ``dst``, ``eid`` and its property columns, and a
column ``type`` unless all its rows are of one type. A scan touches only sources that can hold what is
asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TYPES, Catalog


def column(key: str) -> str:
    """The column of a property; apart from the structural ones, whatever the property's name."""
    return f"p_{key}"


class _Lazy:
    """A source's table, made when a query first needs it."""

    @property
    def df(self) -> DataFrame:
        if callable(self.table):
            object.__setattr__(self, "table", self.table())
        return self.table


@dataclass(frozen=True)
class NodeSource(_Lazy):
    table: DataFrame | Callable[[], DataFrame]
    fixed: tuple[str, ...]  # labels every row carries
    varying: tuple[str, ...] = ()  # further labels rows may carry, in the column labels
    keys: tuple[str, ...] = ()

    def may_hold(self, labels: Iterable[str]) -> bool:
        return all(x in self.fixed or x in self.varying for x in labels)


@dataclass(frozen=True)
class EdgeSource(_Lazy):
    table: DataFrame | Callable[[], DataFrame]
    types: tuple[str, ...]  # one: all rows are of it; several: see the column type
    src: tuple[str, ...] = ()  # labels that all start nodes, all end nodes carry
    dst: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


@dataclass
class GraphView:
    """``closed``: every edge's ends are nodes of the view, so a node that only has to exist needs no join."""

    spark: SparkSession
    catalog: Catalog
    node_sources: Sequence[NodeSource]
    edge_sources: Sequence[EdgeSource]
    closed: bool = True
    extra: dict = field(default_factory=dict)

    def nodes(self, labels: Sequence[str] = (), keys: Sequence[str] = (), with_labels: bool = False, extra: Sequence[str] = (), having: str | None = None) -> DataFrame:
        """vid [, labels], keys and stored columns ``extra`` of nodes that carry all ``labels``.

        With ``having``, sources that don't have this key at all are left out.
        """
        parts = []
        for s in self.node_sources:
            if not s.may_hold(labels) or (having is not None and having not in s.keys):
                continue
            df = s.df
            for x in labels:
                if x not in s.fixed:
                    df = df.filter(F.array_contains("labels", x))
            cols = [F.col("vid").cast("long").alias("vid")]
            if with_labels:
                cols.append((F.col("labels") if s.varying else F.array(*[F.lit(x) for x in sorted(s.fixed)]).cast("array<string>")).alias("labels"))
            cols += [self._key(s.keys, k, self.catalog.node_keys) for k in keys]
            cols += [(F.col(c) if c in s.df.columns else F.lit(None).cast("string")).alias(c) for c in extra]
            parts.append(df.select(*cols))
        if parts:
            return reduce(DataFrame.unionByName, parts)
        schema = ["vid long", *(["labels array<string>"] if with_labels else []), *[f"`{column(k)}` {TYPES.get(self.catalog.node_keys.get(k, ''), 'string')}" for k in keys], *[f"`{c}` string" for c in extra]]
        return self.spark.createDataFrame([], ", ".join(schema))

    def edges(self, types: Sequence[str] | None = None, keys: Sequence[str] = (), with_type: bool = False) -> DataFrame:
        """src, dst, eid [, type] and keys of edges of any of ``types`` (None: all)."""
        parts = []
        for s in self.edge_sources:
            have = [t for t in s.types if types is None or t in types]
            if not have:
                continue
            df = s.df
            if len(s.types) > 1 and len(have) < len(s.types):
                df = df.filter(F.col("type").isin(have))
            cols = [F.col(c).cast("long").alias(c) if c in s.df.columns else F.lit(None).cast("long").alias(c) for c in ("src", "dst", "eid")]
            if with_type:
                cols.append((F.lit(s.types[0]) if len(s.types) == 1 else F.col("type")).alias("type"))
            cols += [self._key(s.keys, k, self.catalog.edge_keys) for k in keys]
            parts.append(df.select(*cols))
        if parts:
            return reduce(DataFrame.unionByName, parts)
        schema = ["src long", "dst long", "eid long", *(["type string"] if with_type else []), *[f"`{column(k)}` {TYPES.get(self.catalog.edge_keys.get(k, ''), 'string')}" for k in keys]]
        return self.spark.createDataFrame([], ", ".join(schema))

    @staticmethod
    def _key(have: Sequence[str], k: str, types: dict[str, str]):  # noqa: ANN205
        t = TYPES.get(types.get(k, ""), "string")
        return (F.col(f"`{column(k)}`").cast(t) if k in have else F.lit(None).cast(t)).alias(column(k))

    def end_labels(self, types: Sequence[str] | None, end: str) -> set[str]:
        """Labels that the ``src`` or ``dst`` of every such edge is known to carry."""
        sets = [set(getattr(s, end)) for s in self.edge_sources if types is None or any(t in s.types for t in types)]
        return set.intersection(*sets) if sets else set()


def view_of(spark: SparkSession, nodes: DataFrame, edges: DataFrame, catalog: Catalog, closed: bool = True) -> GraphView:
    """A view of two stored tables: nodes (vid, labels, keys), edges (eid, src, dst, type, keys)."""
    n = NodeSource(nodes, (), tuple(catalog.labels), tuple(k for k in catalog.node_keys if column(k) in nodes.columns))
    types = tuple(catalog.edge_types)
    # a single type still has to be looked up in the column: rows may hold types the catalogue lacks
    e = EdgeSource(edges, types if len(types) != 1 else (*types, ""), (), (), tuple(k for k in catalog.edge_keys if column(k) in edges.columns))
    return GraphView(spark, catalog, [n], [e] if types else [], closed)
