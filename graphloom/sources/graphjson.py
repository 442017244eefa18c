"""A small graph as one JSON document: names, then nodes and edges that refer to them by number.

``{"v": 1, "labels": [...], "edgeTypes": [...], "propKeys": [...], "nodes": [{"id", "l", "p"}], "edges":
[{"s", "d", "t", "p"}]}``: ``l`` and ``t`` are numbers of labels and an edge type, ``p`` maps the number
of a property key to a value. Meant for samples; what is read or written passes through the driver.
"""

from __future__ import annotations

import json
from typing import Any

from ..errors import DataError
from ..graph import Graph
from ..model import column

VERSION = 1


def load(graph: Graph, text: str) -> dict[int, int]:
    """Add the document's nodes and edges in one transaction; returns their ids -> vids."""
    d = json.loads(text)
    if d.get("v", 0) != VERSION:
        raise DataError(f"version {d.get('v', 0)} of graph data, not {VERSION}")
    keys = d.get("propKeys", [])
    props = lambda x: {keys[int(k)]: v for k, v in (x.get("p") or {}).items()}

    def body(t: Any) -> dict[int, int]:
        ids = {n["id"]: t.add_node([d["labels"][i] for i in n["l"]], props(n)) for n in d.get("nodes", [])}
        for e in d.get("edges", []):
            if e["s"] not in ids or e["d"] not in ids:
                raise DataError(f"an edge names no node: {e['s']} -> {e['d']}")
            t.add_edge(ids[e["s"]], ids[e["d"]], d["edgeTypes"][e["t"]], props(e))
        return ids

    return graph.transact(body)


def dump(graph: Graph) -> str:
    c = graph.catalog
    keys = list(dict.fromkeys([*c.node_keys, *c.edge_keys]))

    def props(r: Any, of: dict[str, str]) -> dict[str, Any]:
        nulls = set(r["null_keys"] or [])
        return {str(keys.index(k)): r[column(k)] for k in of if column(k) in r.__fields__ and (r[column(k)] is not None or k in nulls)}

    nodes = [{"id": r.vid, "l": [c.label_id(x) for x in r.labels], "p": props(r, c.node_keys)} for r in graph.version.nodes.orderBy("vid").toLocalIterator()]
    edges = [{"s": r.src, "d": r.dst, "t": c.edge_type_id(r.type), "p": props(r, c.edge_keys)} for r in graph.version.edges.orderBy("eid").toLocalIterator()]
    return json.dumps({"v": VERSION, "labels": c.labels, "edgeTypes": c.edge_types, "propKeys": keys, "nodes": nodes, "edges": edges})
