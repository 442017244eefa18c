"""From log records to the next version of a graph, and recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog
from .errors import CorruptionDetected
from .graph import Constraint, Graph, Index, Version, typed_value, with_columns, without_nodes
from .model import column


def newest(records: DataFrame, *keys: str) -> DataFrame:
    """The record with the greatest lsn of each key."""
    last = records.groupBy(*keys).agg(F.max_by(F.struct(*records.columns), "lsn").alias("r"))
    return last.select("r.*")


def apply_log(v: Version, log: DataFrame, cat: Catalog) -> Version:
    """The version after the records of ``log``, which are committed and newer than ``v``.

    Everything is a join on ids: the newest record of each property and label counts, entities that
    are deleted go with their edges. Properties are wide again before they meet the tables.
    """

    def part(base: DataFrame, i: str, keys: dict[str, str], kind: str, cols: list[str]) -> DataFrame:
        base = with_columns(base, keys)
        new = newest(log.filter(F.col("op") == f"Add{kind}"), i).select(i, *cols).withColumn("null_keys", F.array().cast("array<string>"))
        base = base.unionByName(with_columns(new, keys))
        sets = newest(log.filter(F.col("op").isin(f"Set{kind}Prop", f"Del{kind}Prop")), i, "key").withColumn("value", F.when(F.col("op") == f"Set{kind}Prop", F.col("value")))
        used = sorted(k for k in (r.key for r in sets.select("key").distinct().collect()) if k in keys)
        if used:
            values = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"\x1f{k}") for k in used]
            wide = sets.groupBy(i).agg(F.collect_set("key").alias("\x1fset"), F.collect_set(F.when(F.col("value") == "null", F.col("key"))).alias("\x1fnull"), *values)
            j = base.join(wide, i, "left")
            out = {column(k): F.when(F.array_contains("\x1fset", k), typed_value(F.col(f"`\x1f{k}`"), keys[k])).otherwise(F.col(f"`{column(k)}`")) for k in used}
            kept = F.array_except(F.coalesce("null_keys", F.array().cast("array<string>")), "\x1fset")
            out["null_keys"] = F.when(F.col("\x1fset").isNotNull(), F.array_union(kept, "\x1fnull")).otherwise(F.col("null_keys"))
            base = j.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in base.columns])
        return base.join(log.filter(F.col("op") == f"Del{kind}").select(i).distinct(), i, "left_anti").select(*base.columns)

    nodes = part(v.nodes, "vid", cat.node_keys, "Node", ["logical_id", "labels"])
    edges = part(v.edges, "eid", cat.edge_keys, "Edge", ["logical_id", "src", "dst", "type"])
    edges = without_nodes(edges, log.filter("op = 'DelNode'").select("vid").distinct())
    side = lambda c, on: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(x.alias("l"), F.lit(on).alias("on")))
    marks = log.filter("op = 'SetNodeLabels'").select("vid", "lsn", F.explode(F.concat(side(F.col("labels"), True), side(F.col("removed"), False))).alias("m")).select("vid", "lsn", "m.l", "m.on")
    marks = newest(marks, "vid", "l").groupBy("vid").agg(F.collect_set(F.when(F.col("on"), F.col("l"))).alias("\x1fon"), F.collect_set("l").alias("\x1fall"))
    j = nodes.join(marks, "vid", "left")
    labels = F.when(F.col("\x1fall").isNotNull(), F.array_sort(F.array_union(F.array_except("labels", "\x1fall"), "\x1fon"))).otherwise(F.col("labels"))
    nodes = j.select(*[(labels if c == "labels" else F.col(f"`{c}`")).alias(c) for c in nodes.columns])
    return Version(nodes, edges, cat, v.lsn, v.deltas + 1)


def change_schema(g: Graph, op: dict) -> None:
    """Take over one logged change of the schema; the catalogue is that of the graph's version."""
    cat, what = g.version.catalog, op["op"]
    if what == "InternString":
        got = cat.intern_label(op["name"]) if op["kind"] == "label" else cat.intern_edge_type(op["name"])
        if got != op["id"]:
            raise CorruptionDetected(f"{op['kind']} {op['name']} has id {got}, not {op['id']}")
    elif what == "DeclareColumn":
        cat.declare(op["owner"], op["key"], op["type"])
    elif what == "DropColumn":
        cat.drop(op["owner"], op["key"])
        v = g.version
        df = (v.nodes if op["owner"] == "node" else v.edges).drop(column(op["key"]))
        g._rebase(Version(df if op["owner"] == "node" else v.nodes, df if op["owner"] == "edge" else v.edges, cat, v.lsn, v.deltas))
    elif what == "DeclareConstraint":
        c = Constraint(**{k: x for k, x in op.items() if k != "op"})
        g.constraints[c.name] = c
    elif what == "DropConstraint":
        g.constraints.pop(op["name"], None)
    elif what == "DeclareIndex":
        g.indexes[op["name"]] = Index(**{k: x for k, x in op.items() if k != "op"})
    elif what == "DropIndex":
        g.indexes.pop(op["name"], None)
    else:
        raise CorruptionDetected(f"unknown change of the schema {what}")


def check_new(v: Version, log: DataFrame) -> None:
    """Ids that the log gives must be new, in the log and in the tables it is applied to."""
    for op, i, base in (("AddNode", "logical_id", v.nodes), ("AddNode", "vid", v.nodes), ("AddEdge", "eid", v.edges)):
        gone = log.filter("op = 'DelNode'").select("vid") if op == "AddNode" else None
        added = log.filter(F.col("op") == op).select(i, *(["vid"] if i != "vid" and op == "AddNode" else []))
        if i == "logical_id":  # that of a deleted node is free again
            there = base.select("logical_id", "vid").join(gone, "vid", "left_anti").select("logical_id")
            added = added.join(gone, "vid", "left_anti").select("logical_id")
        else:
            there, added = base.select(i), added.select(i)
        twice = added.filter(F.col(i).isNotNull()).select(i, F.lit(1).alias("new")).unionByName(there.select(i, F.lit(0).alias("new"))).groupBy(i).agg(F.count(F.lit(1)).alias("n"), F.max("new").alias("new")).filter("n > 1 and new = 1").limit(1).collect()
        if twice:
            raise CorruptionDetected(f"{op}: {i} {twice[0][0]} is given twice")


def replay(g: Graph) -> Graph:
    """Apply the committed transactions that follow the graph's version, in one pass between changes that drop columns.

    A torn transaction ends the log: it and what follows it are set aside.
    """
    commits = list(g.journal.transactions(g.version.lsn))
    known = g.journal.numbers()
    whole = {m["txn"] for m in commits}
    if any(n > g.txn and n not in whole for n in known):
        g.journal.set_aside()
    g.version = Version(g.version.nodes, g.version.edges, g.version.catalog.copy(), g.version.lsn, g.version.deltas)
    group: list[dict] = []

    def apply() -> None:
        data = [m for m in group if m["n_records"]]
        group.clear()
        if not data:
            return
        log = g.journal.records(data).filter(F.col("lsn") > g.version.lsn).filter(~F.col("op").isin("BeginTxn", "CommitTxn"))
        check_new(g.version, log)
        vid, eid = log.agg(F.max(F.when(F.col("op") == "AddNode", F.col("vid"))), F.max(F.when(F.col("op") == "AddEdge", F.col("eid")))).first()
        g.next_vid, g.next_eid = max(g.next_vid, -1 if vid is None else vid + 1), max(g.next_eid, -1 if eid is None else eid + 1)
        v = apply_log(g.version, log, g.version.catalog)
        g._rebase(Version(v.nodes, v.edges, v.catalog, g.version.lsn, v.deltas))

    for m in commits:
        if any(o["op"] == "DropColumn" for o in m["schema"]):
            apply()
        for o in m["schema"]:
            change_schema(g, o)
        group.append(m)
        g.txn = max(g.txn, m["txn"])
    top = commits[-1]["commit_lsn"] if commits else g.version.lsn
    apply()
    g.version = Version(g.version.nodes, g.version.edges, g.version.catalog, top, g.version.deltas)
    g._base = g.version
    if commits:
        g.merge_now()
    return g
