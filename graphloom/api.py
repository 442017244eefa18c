"""Reads without the query language: scans, lookups, neighbours, degrees, export.

Every function takes a GraphView and gives a lazy DataFrame. Lookups compare without coercion: a value
whose type is not the key's finds nothing, and null finds what is explicitly null.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import TYPES, type_of
from .errors import SchemaError
from .model import GraphView, column
from .plans.walk import reach


def label_scan(view: GraphView, *labels: str) -> DataFrame:
    """(vid), ascending."""
    return view.nodes(labels).orderBy("vid")


def find_nodes(view: GraphView, key: str, value: Any, label: str | None = None) -> DataFrame:
    """(vid), ascending, of nodes whose ``key`` equals ``value``."""
    labels = (label,) if label else ()
    if value is None:
        df = view.nodes(labels, (), extra=("null_keys",))
        return df.filter(F.array_contains("null_keys", key) if dict(df.dtypes)["null_keys"].startswith("array") else F.lit(False)).select("vid").orderBy("vid")
    if view.catalog.node_keys.get(key) != type_of(value):
        return view.nodes(labels).limit(0)
    return view.nodes(labels, (key,), having=key).filter(F.col(f"`{column(key)}`") == F.lit(value).cast(TYPES[type_of(value)])).select("vid").orderBy("vid")


def find_node(view: GraphView, key: str, value: Any, label: str | None = None) -> DataFrame:
    return find_nodes(view, key, value, label).limit(1)


def by_logical_id(view: GraphView, logical_id: str) -> DataFrame:
    return view.nodes(extra=("logical_id",)).filter(F.col("logical_id") == logical_id).select("vid")


def logical_ids(view: GraphView, vids: DataFrame) -> DataFrame:
    """(vid, logical_id) of those of ``vids`` (vid) that are nodes."""
    return view.nodes(extra=("logical_id",)).join(vids.select("vid"), "vid", "left_semi").select("vid", "logical_id")


def visible(view: GraphView, vids: DataFrame) -> DataFrame:
    """(vid, visible): whether each id is a node of the view."""
    return vids.select("vid").join(view.nodes().withColumn("visible", F.lit(True)), "vid", "left").select("vid", F.coalesce("visible", F.lit(False)).alias("visible"))


def has_label(view: GraphView, vids: DataFrame, label: str) -> DataFrame:
    """(vid, has): whether each id is a node that carries the label."""
    there = view.nodes((label,)).withColumn("has", F.lit(True))
    return vids.select("vid").join(there, "vid", "left").select("vid", F.coalesce("has", F.lit(False)).alias("has"))


def property_type(view: GraphView, owner: str, key: str) -> str | None:
    """The declared type of a node or edge property, or None."""
    return view.catalog.keys(owner).get(key)


def typed_values(view: GraphView, key: str, value_type: str, labels: Sequence[str] = ()) -> DataFrame:
    """(vid, value) like ``property_values``; a key that is unknown or of another type is an error."""
    have = property_type(view, "node", key)
    if have != value_type:
        raise SchemaError(f"property {key!r} is {have or 'unknown'}, not {value_type}")
    return property_values(view, key, labels)


def edge_values(view: GraphView, key: str, types: Sequence[str] | None = None) -> DataFrame:
    """(src, dst, eid, value) of every edge that has the property."""
    return view.edges(types, (key,)).select("src", "dst", "eid", F.col(f"`{column(key)}`").alias("value")).filter("value is not null")


def property_states(view: GraphView, key: str, labels: Sequence[str] = ()) -> DataFrame:
    """(vid, state): ``value``, ``null`` where it was set to null, ``absent`` where it was never set."""
    df = view.nodes(labels, (key,), extra=("null_keys",))
    null = F.array_contains("null_keys", key) if dict(df.dtypes)["null_keys"].startswith("array") else F.lit(False)
    return df.select("vid", F.when(F.col(f"`{column(key)}`").isNotNull(), "value").when(null, "null").otherwise("absent").alias("state"))


def topology(view: GraphView) -> DataFrame:
    """(nodes, edges, id_space, tombstones, dangling): of the view; ``dangling`` counts edges with an end that is no node."""
    ends = view.edges().select(F.monotonically_increasing_id().alias("i"), F.explode(F.array("src", "dst")).alias("vid"))
    lost = ends.join(view.nodes(), "vid", "left_anti").agg(F.countDistinct("i").alias("dangling"))
    return counts(view).select("nodes", "edges", "id_space", (F.col("id_space") - F.col("nodes")).alias("tombstones"), lost.scalar().alias("dangling"))


def neighbours(view: GraphView, vids: DataFrame, direction: str = "out", types: Sequence[str] | None = None) -> DataFrame:
    """(vid, neighbour, eid, type) of the nodes ``vids`` (vid)."""
    e = view.edges(types, (), with_type=True)
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = e.select(F.col(a).alias("vid"), F.col(b).alias("neighbour"), "eid", "type")
    if not view.closed:  # an end that is no node is no neighbour
        e = e.join(view.nodes().withColumnRenamed("vid", "neighbour"), "neighbour", "left_semi")
    return vids.select("vid").join(e.select("vid", "neighbour", "eid", "type"), "vid")


def property_values(view: GraphView, key: str, labels: Sequence[str] = ()) -> DataFrame:
    """(vid, value) of every node that has the property."""
    return view.nodes(labels, (key,), having=key).select("vid", F.col(f"`{column(key)}`").alias("value")).filter("value is not null")


def counts(view: GraphView) -> DataFrame:
    """(nodes, edges, id_space): nodes there are, edges, and the size of the id space with deleted ids."""
    n = view.nodes().select(F.lit("n").alias("k"), "vid", F.lit(1).alias("a"), F.lit(0).alias("b"))
    e = view.edges().select(F.lit("e").alias("k"), F.lit(None).cast("long").alias("vid"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return n.unionByName(e).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("b"), F.lit(0)).alias("edges"), F.coalesce(F.max("vid") + 1, F.lit(0)).alias("id_space"))


def degrees(view: GraphView, labels: Sequence[str] = (), types: Sequence[str] | None = None) -> DataFrame:
    """(vid, out_degree, in_degree) of every node, 0 where there is no edge.

    Both ends are counted in one pass over the edges, partially where they lie, so a hub is no
    heavy key of the shuffle.
    """
    ends = F.explode(F.array(F.struct(F.col("src").alias("vid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vid"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    d = view.edges(types).select(ends.alias("x")).groupBy("x.vid").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i"))
    return view.nodes(labels).join(d, "vid", "left").select("vid", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def hubs(view: GraphView, k: int, types: Sequence[str] | None = None) -> DataFrame:
    """(vid, out_degree): the ``k`` nodes with most out-edges; of equal ones the lesser ids."""
    return view.edges(types).filter("src is not null").groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("out_degree")).orderBy(F.desc("out_degree"), "vid").limit(k)


def degree_stats(view: GraphView, types: Sequence[str] | None = None) -> DataFrame:
    """(nodes, edges, mean, most) of out-degrees."""
    return degrees(view, (), types).agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").alias("edges"), F.avg("out_degree").alias("mean"), F.max("out_degree").alias("most"))


def two_hops(view: GraphView, seeds: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """(start, node, hops): distinct nodes at one or two hops of each seed (vid)."""
    return reach(seeds.select(F.col("vid").alias("start")).distinct(), view.edges(types).select("src", "dst"), 1, 2)


def export_nodes(view: GraphView, labels: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(logical_id, labels, props) of nodes that carry any of ``labels`` (None: all)."""
    keys = list(view.catalog.node_keys)
    df = view.nodes((), keys, True, ("logical_id",))
    if labels is not None:
        df = df.filter(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]).cast("array<string>")))
    props = F.to_json(F.struct(*[F.col(f"`{column(k)}`").alias(k) for k in keys])) if keys else F.lit("{}")
    df = df.select("vid", "logical_id", F.array_sort("labels").alias("labels"), props.alias("props"))
    return df if limit is None else df.orderBy("vid").limit(limit)


def export_edges(view: GraphView, types: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """(src, dst, type, props) of edges of any of ``types`` (None: all)."""
    keys = list(view.catalog.edge_keys)
    props = F.to_json(F.struct(*[F.col(f"`{column(k)}`").alias(k) for k in keys])) if keys else F.lit("{}")
    df = view.edges(types, keys, True).select("src", "dst", "type", "eid", props.alias("props"))
    return (df if limit is None else df.orderBy("src", "dst", "type", "eid", "props").limit(limit)).drop("eid")
