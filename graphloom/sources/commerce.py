"""The relational tables of a data folder as a property graph.

Node ids are a label's ordinal in the high bits and the table's key in the low ones, so they are the
same in every session. Timestamps become microseconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..model import EdgeSource, GraphView, NodeSource, column
from ..operators.orphans import node_names, reference_key
from .tables import table

LABELS = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "User", "Event", "Document", "English", "Long")
NODE_KEYS = {
    "regionkey": "int", "nationkey": "int", "custkey": "int", "suppkey": "int", "partkey": "int", "orderkey": "int", "userid": "int", "eventid": "int", "docid": "int",
    "name": "string", "acctbal": "double", "mktsegment": "string", "brand": "string", "type": "string", "size": "int", "retailprice": "double", "status": "string",
    "totalprice": "double", "orderdate": "int", "priority": "string", "ts": "int", "etype": "string", "value": "double", "lang": "string", "source": "string", "nchars": "int", "author": "string",
}
EDGE_KEYS = {"linenumber": "int", "suppkey": "int", "quantity": "double", "extendedprice": "double", "discount": "double", "tax": "double", "returnflag": "string", "linestatus": "string", "shipdate": "int", "gap": "int"}
TYPES = ("IN_REGION", "LOCATED_IN", "PLACED", "CONTAINS", "SUPPLIES", "DID", "NEXT", "PARENT")


def vid(label: str, key: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return k.cast("long") + (LABELS.index(label) << 40)


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# label -> (table, its key, properties as name = column)
NODES = {
    "Region": ("region", "r_regionkey", "regionkey=r_regionkey name=r_name"),
    "Nation": ("nation", "n_nationkey", "nationkey=n_nationkey name=n_name"),
    "Customer": ("customer", "c_custkey", "custkey=c_custkey name=c_name acctbal=c_acctbal mktsegment=c_mktsegment"),
    "Supplier": ("supplier", "s_suppkey", "suppkey=s_suppkey name=s_name acctbal=s_acctbal"),
    "Part": ("part", "p_partkey", "partkey=p_partkey name=p_name brand=p_brand type=p_type size=p_size retailprice=p_retailprice"),
    "Order": ("orders", "o_orderkey", "orderkey=o_orderkey status=o_orderstatus totalprice=o_totalprice orderdate=o_orderdate priority=o_orderpriority"),
    "User": ("events", "user_id", "userid=user_id"),
    "Event": ("events", "event_id", "eventid=event_id ts=ts etype=event_type value=value"),
    "Document": ("documents", "doc_id", "docid=doc_id lang=lang source=source nchars=n_chars author=author"),
}
# type, table, start's label and column, end's label and column, properties; the tables of NEXT and PARENT are derived
EDGES = [
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey", ""),
    ("LOCATED_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey", ""),
    ("LOCATED_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey", ""),
    ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey", ""),
    ("CONTAINS", "lineitem", "Order", "l_orderkey", "Part", "l_partkey", "linenumber=l_linenumber suppkey=l_suppkey quantity=l_quantity extendedprice=l_extendedprice discount=l_discount tax=l_tax returnflag=l_returnflag linestatus=l_linestatus shipdate=l_shipdate"),
    ("SUPPLIES", "lineitem", "Supplier", "l_suppkey", "Part", "l_partkey", ""),
    ("DID", "events", "User", "user_id", "Event", "event_id", ""),
    ("NEXT", "events", "Event", "event_id", "Event", "next_id", "gap=gap"),
    ("PARENT", "documents", "Document", "doc_id", "Document", "parent", ""),
]
TIMES = ("orderdate", "ts", "shipdate")


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split("=")) for x in text.split()]


def _props(text: str, types: dict[str, str]) -> list[Column]:
    spark_types = {"int": "bigint", "double": "double", "string": "string"}
    return [(micros(col) if name in TIMES else F.col(col).cast(spark_types[types[name]])).alias(column(name)) for name, col in _pairs(text)]


def commerce(spark: SparkSession, folder: str) -> GraphView:
    """Tables are opened when a query first needs them."""

    def nodes(label: str) -> NodeSource:
        name, key, props = NODES[label]

        def make() -> DataFrame:
            t = table(spark, folder, name)
            if label == "User":
                t = t.filter("user_id is not null").select("user_id").distinct()
            cols = [vid(label, key).alias("vid"), *_props(props, NODE_KEYS)]
            if label == "Document":
                has = F.array(F.lit("Document"), F.when(F.col("lang") == "en", "English"), F.when(F.col("n_chars") >= 1000, "Long"))
                cols.append(F.array_sort(F.array_compact(has)).alias("labels"))
            return t.select(*cols)

        return NodeSource(make, (label,), ("English", "Long") if label == "Document" else (), tuple(k for k, _ in _pairs(props)))

    def edges(kind: str, name: str, a: str, src: str, b: str, dst: str, props: str) -> EdgeSource:
        def make() -> DataFrame:
            t = table(spark, folder, name)
            if kind == "SUPPLIES":
                t = t.select(src, dst).distinct()
            elif kind == "DID":
                t = t.filter("user_id is not null")
            elif kind == "NEXT":  # the next event of the same user, by time
                after = F.expr("lead(struct(event_id, ts)) over (partition by user_id order by ts, event_id)")
                t = t.filter("user_id is not null").select("event_id", "ts", after.alias("n")).filter("n is not null")
                t = t.select("event_id", F.col("n.event_id").alias("next_id"), (F.unix_micros(F.col("n.ts").cast("timestamp")) - micros("ts")).alias("gap"))
            elif kind == "PARENT":
                of = t.filter("commit_sha is not null").select(F.col("doc_id").alias("parent"), F.col("commit_sha").alias("sha"))
                t = t.filter("parent_sha is not null").select("doc_id", F.col("parent_sha").alias("sha")).join(of, "sha")
            return t.select(vid(a, src).alias("src"), vid(b, dst).alias("dst"), *_props(props, EDGE_KEYS))

        return EdgeSource(make, (kind,), (a,), (b,), tuple(k for k, _ in _pairs(props)))

    cat = Catalog(dict(NODE_KEYS), dict(EDGE_KEYS), list(LABELS), list(TYPES))
    return GraphView(spark, cat, [nodes(x) for x in NODES], [edges(*x) for x in EDGES])


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _declared(spark: SparkSession, folder: str, owner: str) -> dict[str, str]:
    """Property keys and their types; the declaration is a schema, so it fits on the driver."""
    keys = table(spark, folder, "prop_keys").filter((F.col("owner_kind") == owner) & F.col("key_name").isNotNull())
    return {k.key_name: k.value_type for k in keys.select("key_id", "key_name", "value_type").distinct().orderBy("key_id").collect()}


def _read(props: str, key: str, value_type: str) -> Column:
    """A property of a JSON object in its declared type; null where it cannot be read."""
    text = F.get_json_object(props, f"$['{key}']")
    low = F.lower(F.trim(text))
    number = F.when(text.rlike(_NUMBER), text).try_cast("double")
    return {"int": text.try_cast("bigint"), "double": F.when(F.abs(number) < float("inf"), number), "bool": F.when(low.isin("true", "false"), low == "true"), "string": text}[value_type].alias(column(key))


def exported(spark: SparkSession, folder: str) -> GraphView:
    """The exported nodes and edges as a graph, with the declared properties: the last load of each node that is not deleted.

    An edge's end names a node by its id in any spelling of the UUID or by ``local-<vid>``. Edges with an
    end that names none of these nodes dangle and are left out; repeated edges count once.
    """
    n = table(spark, folder, "graph_nodes")
    last = n.groupBy("logical_id", "vid").agg(F.max_by(F.struct("labels", "props"), "loaded_at").alias("x"), F.max("deleted_at").alias("gone")).filter("gone is null")
    node_keys, edge_keys = _declared(spark, folder, "node"), _declared(spark, folder, "edge")
    keys = [_read("x.props", k, t) for k, t in node_keys.items()]
    nodes = last.select("vid", "logical_id", F.array_sort(F.coalesce("x.labels", F.array().cast("array<string>"))).alias("labels"), *keys)
    names = last.select(node_names(F.col("logical_id"), F.col("vid")).alias("key"), "vid").filter("key is not null").distinct()
    end = lambda c: reference_key(F.col(f"{c}_logical_id")).alias(f"{c}_key")
    e = table(spark, folder, "graph_edges").select("logical_id", "edge_type", end("src"), end("dst"), "props", "loaded_at")
    edges = (
        e.join(names.select(F.col("key").alias("src_key"), F.col("vid").alias("src")), "src_key")
        .join(names.select(F.col("key").alias("dst_key"), F.col("vid").alias("dst")), "dst_key")
        .groupBy("src", "dst", F.col("logical_id").alias("edge_logical_id"), F.col("edge_type").alias("type"))
        .agg(F.max(F.struct("loaded_at", "props")).alias("x"))
        .select("src", "dst", F.lit(None).cast("long").alias("eid"), "edge_logical_id", "type", *[_read("x.props", k, t) for k, t in edge_keys.items()])
    )
    labels = ("Person", "Company", "Post", "Comment", "Place", "Topic", "Device", "Archived", "Verified")
    types = ("knows", "worksAt", "founded", "CREATED", "REPLY_OF", "locatedIn", "tagged", "owns")
    cat = Catalog(node_keys, edge_keys, list(labels), list(types))
    return GraphView(spark, cat, [NodeSource(nodes, (), labels, tuple(node_keys))], [EdgeSource(edges, types, keys=tuple(edge_keys))])
