"""A declared schema over a graph: columns are reserved at once, values are checked when they come."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from . import api
from .catalog import box
from .errors import SchemaError
from .graph import Graph


class GraphSchema:
    def __init__(self, graph: Graph, labels: Sequence[str], edge_types: Sequence[str], node_keys: Mapping[str, str]) -> None:
        """Fails, changing nothing, if a key has another type already."""
        cat = graph.catalog.copy()
        for k, t in node_keys.items():
            cat.declare("node", k, t)
        for x in labels:
            cat.intern_label(x)
        for x in edge_types:
            cat.intern_edge_type(x)
        if cat.version != graph.catalog.version:
            graph._change_schema(cat)
        self.graph, self.labels, self.edge_types, self.keys = graph, set(labels), set(edge_types), dict(node_keys)

    def _boxed(self, key: str, value: Any) -> Any:
        if key not in self.keys:
            raise SchemaError(f"undeclared property {key!r}")
        return box(value, self.keys[key], key)

    def add(self, label: str, props: Mapping[str, Any] | None = None, logical_id: str | None = None) -> int:
        if label not in self.labels:
            raise SchemaError(f"undeclared label {label!r}")
        boxed = {k: self._boxed(k, v) for k, v in (props or {}).items()}
        return self.graph.transact(lambda t: t.add_node([label], boxed, logical_id))

    def connect(self, src: int, dst: int, edge_type: str) -> int:
        if edge_type not in self.edge_types:
            raise SchemaError(f"undeclared edge type {edge_type!r}")
        return self.graph.transact(lambda t: t.add_edge(src, dst, edge_type))

    def find(self, label: str, key: str, value: Any) -> int | None:
        row = api.find_node(self.graph.view, key, self._boxed(key, value), label).first()
        return row.vid if row else None

    def find_all(self, label: str, key: str, value: Any) -> DataFrame:
        return api.find_nodes(self.graph.view, key, self._boxed(key, value), label)

    def neighbours(self, vid: int, edge_type: str, direction: str = "out") -> DataFrame:
        """(neighbour)"""
        one = self.graph.spark.createDataFrame([(vid,)], "vid long")
        return api.neighbours(self.graph.view, one, direction, [edge_type]).select("neighbour")
