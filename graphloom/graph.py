"""A mutable property graph: immutable versions of two tables, a log, transactions and constraints.

Every commit gives a new version; a version, once taken, never changes, so a pinned one is a true
snapshot. A commit is written to the log first, as one folder, and counts once its commit file is in
place (``journal``). Bulk changes (SET and DELETE of a query) stay DataFrames from the match to the log
to the next version; nothing of them passes through the driver. Changes of single entities are kept
on the driver as one net change over the stored tables, so that a version is one join deep however
many commits it has; they are folded into new tables when there are many.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TYPES, Catalog, box, type_of
from .errors import ConstraintViolation, DataError, GraphClosed, NotFound, PlanError, SchemaError
from .functions.scalars import literal
from .model import GraphView, column, view_of
from .plans.compile import Diagnostic, Planner, Rows
from .plans.query import CACHE
from .plans.syntax import Item, Statement, Var
from .journal import LOG, SCHEMA_OPS, Files, Journal
from .session import scratch

NODE = "vid long, logical_id string, labels array<string>, null_keys array<string>"
EDGE = "eid long, logical_id string, src long, dst long, type string, null_keys array<string>"
#: Bulk changes kept as deltas over the last stored tables before they are folded into new ones.
FOLD_AFTER = 8
#: Changes of single entities kept on the driver before they are folded.
FOLD_OPS = 10_000
#: A checkpoint is due beyond so many bytes of log.
CHECKPOINT_BYTES = 8 << 20
#: Commits of a level other than fsync held back at most, until the next flush.
GROUP = 256
DURABILITY = ("fsync", "group", "periodic", "none")


@dataclass(frozen=True)
class Version:
    nodes: DataFrame
    edges: DataFrame
    catalog: Catalog
    lsn: int = 0
    deltas: int = 0


@dataclass(frozen=True)
class Constraint:
    kind: str  # unique or exists
    label: str  # of nodes; empty: all
    key: str
    owner: str = "node"

    @property
    def name(self) -> str:
        return f"{self.kind}:{'' if self.owner == 'node' else 'edge '}{self.label}.{self.key}"


@dataclass(frozen=True)
class Index:
    name: str
    owner: str
    key: str
    unique: bool = False
    label: str | None = None
    mode: str = "inline"  # inline, deferred, incremental or batch


class Pin:
    """A version that stays readable until it is released, whatever is committed since."""

    def __init__(self, graph: Graph) -> None:
        self.lsn, self.view, self._graph = graph.current_lsn, graph.view, graph
        graph.pins.append(self)

    def __getattr__(self, name: str) -> Any:
        return getattr(self.__dict__["view"], name)

    def release(self) -> None:
        if self in self._graph.pins:
            self._graph.pins.remove(self)

    def __enter__(self) -> Pin:
        return self

    def __exit__(self, *exc: object) -> None:
        self.release()


@dataclass
class Txn:
    """Changes of one transaction, in order. Ids are given at once and not reused if it is rolled back."""

    graph: Graph
    ops: list[dict] = field(default_factory=list)

    def add_node(self, labels: Sequence[str], props: Mapping[str, Any] | None = None, logical_id: str | None = None) -> int:
        if not labels:
            raise DataError("a node needs a label")
        vid = self.graph.next_vid
        self.graph.next_vid += 1
        self.ops.append({"op": "AddNode", "vid": vid, "labels": sorted(set(labels)), "logical_id": logical_id or str(uuid.uuid4()), "props": dict(props or {})})
        return vid

    def add_edge(self, src: int, dst: int, edge_type: str, props: Mapping[str, Any] | None = None, logical_id: str | None = None) -> int:
        eid = self.graph.next_eid
        self.graph.next_eid += 1
        self.ops.append({"op": "AddEdge", "eid": eid, "src": src, "dst": dst, "type": edge_type, "logical_id": logical_id or str(uuid.uuid4()), "props": dict(props or {})})
        return eid

    def del_node(self, vid: int) -> None:
        self.ops.append({"op": "DelNode", "vid": vid})

    def del_edge(self, eid: int) -> None:
        self.ops.append({"op": "DelEdge", "eid": eid})

    def set_node_prop(self, vid: int, key: str, value: Any) -> None:
        self.ops.append({"op": "SetNodeProp", "vid": vid, "key": key, "value": value})

    def set_edge_prop(self, eid: int, key: str, value: Any) -> None:
        self.ops.append({"op": "SetEdgeProp", "eid": eid, "key": key, "value": value})

    def del_node_prop(self, vid: int, key: str) -> None:
        self.ops.append({"op": "DelNodeProp", "vid": vid, "key": key})

    def del_edge_prop(self, eid: int, key: str) -> None:
        self.ops.append({"op": "DelEdgeProp", "eid": eid, "key": key})

    def set_node_labels(self, vid: int, added: Sequence[str] = (), removed: Sequence[str] = ()) -> None:
        if set(added) & set(removed):
            raise DataError("a label is both added and removed")
        self.ops.append({"op": "SetNodeLabels", "vid": vid, "labels": sorted(set(added)), "removed": sorted(set(removed))})


class Graph:
    def __init__(self, spark: SparkSession, version: Version, path: str | None = None, txn: int = 0, ids: tuple[int, int] | None = None) -> None:
        self.spark, self.version = spark, version
        self.path = path or scratch(spark, "graph")
        self.journal = Journal(spark, self.path)
        self.constraints: dict[str, Constraint] = {}
        self.indexes: dict[str, Index] = {}
        self._built: dict[str, Any] = {}
        self.closed = False
        self.linked = True  # every end of an edge is a node
        self.txn = txn
        self._ids = list(ids) if ids else None
        self._base, self._ops = version, []  # version = base and what the ops leave
        self._waiting: list[tuple[int, int, list, list]] = []  # commits not yet in the log
        self.pins: list[Pin] = []
        self.checkpoint_commits: int | None = None
        self.checkpoint_bytes: int | None = None
        self.on_index_size: Callable[[str, int], None] | None = None

    def _next(self) -> list[int]:
        """The next node and edge ids, looked up when they are first needed."""
        if self._ids is None:
            n = self.version.nodes.select(F.col("vid").alias("a"), F.lit(None).cast("long").alias("b"))
            e = self.version.edges.select(F.lit(None).cast("long").alias("a"), F.col("eid").alias("b"))
            self._ids = [0 if x is None else x + 1 for x in n.unionByName(e).agg(F.max("a"), F.max("b")).first()]
        return self._ids

    @property
    def next_vid(self) -> int:
        return self._next()[0]

    @next_vid.setter
    def next_vid(self, x: int) -> None:
        self._next()[0] = x

    @property
    def next_eid(self) -> int:
        return self._next()[1]

    @next_eid.setter
    def next_eid(self, x: int) -> None:
        self._next()[1] = x

    # -- opening
    @classmethod
    def empty(cls, spark: SparkSession, path: str | None = None) -> Graph:
        return cls(spark, Version(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), Catalog()), path, ids=(0, 0))

    @classmethod
    def of(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame, catalog: Catalog, path: str | None = None, dangling: str = "error") -> Graph:
        """From tables (vid, labels, p_<key>...) and (eid, src, dst, type, p_<key>...); further columns are ignored.

        An edge with an end that is no node is an error; ``dangling="drop"`` leaves such edges out, and
        ``"keep"`` keeps them: a pattern then finds them only where it doesn't name the missing end.
        """
        if dangling not in ("error", "drop", "keep"):
            raise DataError(f"dangling is error, drop or keep, not {dangling}")

        def shaped(df: DataFrame, schema: str, keys: Mapping[str, str]) -> DataFrame:
            cols = [tuple(c.strip().split(" ")) for c in schema.split(",")]
            out = [(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in cols if n != "null_keys"]
            return df.select(*out, F.array().cast("array<string>").alias("null_keys"), *[F.col(f"`{column(k)}`").cast(TYPES[t]).alias(column(k)) for k, t in keys.items() if column(k) in df.columns])

        n, e = shaped(nodes, NODE, catalog.node_keys), shaped(edges, EDGE, catalog.edge_keys)
        if dangling == "error":
            _no_dangling(e, n)
        elif dangling == "drop":
            for end in ("src", "dst"):
                e = e.join(n.select(F.col("vid").alias(end)), end, "left_semi").select(*e.columns)
        g = cls(spark, Version(n, e, catalog), path)
        g.linked = dangling != "keep"
        return g

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Graph:
        """The last checkpoint under ``path`` and the committed transactions after it, up to the first that is torn."""
        from .replay import replay

        m = Journal(spark, path).manifests.read()
        if m is None:
            g = cls.empty(spark, path)
        else:
            base = f"{path}/versions/{m['version']}"
            cat = Catalog(m["node_keys"], m["edge_keys"], m["labels"], m["edge_types"])
            g = cls(spark, Version(spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges"), cat, m["lsn"]), path, m["txn"], (m["next_vid"], m["next_eid"]))
            g.constraints = {c.name: c for c in (Constraint(**x) for x in m["constraints"])}
            g.indexes = {x["name"]: Index(**x) for x in m["indexes"]}
            g.linked = m.get("linked", True)
        return replay(g)

    def close(self) -> None:
        self.flush()
        self.closed = True

    def __enter__(self) -> Graph:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    # -- reading
    @property
    def catalog(self) -> Catalog:
        return self.version.catalog

    @property
    def view(self) -> GraphView:
        return view_of(self.spark, self.version.nodes, self.version.edges, self.catalog, closed=self.linked)

    @property
    def base(self) -> GraphView:
        """The tables of the last fold, without what was written since."""
        return view_of(self.spark, self._base.nodes, self._base.edges, self._base.catalog, closed=self.linked)

    @property
    def has_pending(self) -> bool:
        return bool(self._ops) or self.version.deltas > 0

    def pin(self) -> Pin:
        """A view of this version that later commits don't change."""
        return Pin(self)

    @property
    def min_pinned_lsn(self) -> int | None:
        return min((p.lsn for p in self.pins), default=None)

    @property
    def next_lsn(self) -> int:
        return self.version.lsn + 1

    @property
    def current_lsn(self) -> int:
        return self.version.lsn

    def execute(self, text: str, params: Mapping[str, Any] | None = None, *, strict: bool = False, on_diagnostic: Callable[[Diagnostic], None] | None = None) -> DataFrame:
        """Run a statement. A write without RETURN gives an empty DataFrame without columns."""
        s = CACHE.get(text)
        params = params or {}
        if s.kind == "match" and not s.mutations:
            return Rows(Planner(self.view, s, params, strict, tell=on_diagnostic)).result()
        self._writable()
        if s.kind == "match":
            return self._mutate(s, params, strict)
        return self._create(s, params)

    # -- schema and constraints
    def _change_schema(self, cat: Catalog, *ops: dict, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Log changes of the schema as a transaction of their own, then take them over."""
        self._writable()
        self.flush()
        lsn = self.journal.append(self.txn + 1, self.version.lsn + 1, [], [*_new_names(self.catalog, cat), *ops])
        self.txn += 1
        v = self.version
        if nodes is None and edges is None:
            self._base = _replace(self._base, catalog=cat)
            self.version = _replace(v, catalog=cat, lsn=lsn)
        else:
            self._rebase(Version(v.nodes if nodes is None else nodes, v.edges if edges is None else edges, cat, lsn, v.deltas))

    def declare(self, owner: str, key: str, value_type: str) -> None:
        cat = self.catalog.copy()
        if cat.declare(owner, key, value_type):
            self._change_schema(cat)

    def drop_column(self, owner: str, key: str) -> None:
        cat = self.catalog.copy()
        cat.drop(owner, key)
        n, e = self.version.nodes, self.version.edges
        self._change_schema(cat, {"op": "DropColumn", "owner": owner, "key": key}, nodes=n.drop(column(key)) if owner == "node" else n, edges=e.drop(column(key)) if owner == "edge" else e)

    def add_constraint(self, kind: str, label: str, key: str, owner: str = "node") -> Constraint:
        """``unique`` or ``exists``; refused if the graph violates it already."""
        if kind not in ("unique", "exists") or owner not in ("node", "edge"):
            raise DataError(f"unknown constraint {kind} of {owner}")
        c = Constraint(kind, label, key, owner)
        if c.name not in self.constraints:
            self._check(self.version, [c])
            self._change_schema(self.catalog, {"op": "DeclareConstraint", **c.__dict__})
            self.constraints[c.name] = c
        return c

    def drop_constraint(self, name: str) -> None:
        if name not in self.constraints:
            raise NotFound(f"no constraint {name}")
        self._change_schema(self.catalog, {"op": "DropConstraint", "name": name})
        del self.constraints[name]

    def create_index(self, name: str, owner: str, key: str, unique: bool = False, label: str | None = None, value_type: str | None = None, mode: str = "inline") -> Index:
        """A named index of a node or edge property; with ``unique`` also a constraint.

        ``inline`` and ``batch`` follow every commit when next read, ``incremental`` (int only) by way of
        what was changed since; ``deferred`` answers as of the last ``flush_indexes``.
        """
        if name in self.indexes:
            raise DataError(f"index {name} exists")
        if mode not in ("inline", "deferred", "incremental", "batch") or (unique and mode == "incremental"):
            raise DataError(f"no {'unique ' if unique else ''}index can be {mode}")
        if owner == "edge" and label:
            raise DataError("edges have no labels")
        if key not in self.catalog.keys(owner):
            if value_type is None:
                raise SchemaError(f"no column {key}")
            self.declare(owner, key, value_type)
        if mode == "incremental" and self.catalog.keys(owner)[key] != "int":
            raise DataError("only an int can be indexed incrementally")
        if unique:
            self.add_constraint("unique", label or "", key, owner)
        x = Index(name, owner, key, unique, label, mode)
        self._change_schema(self.catalog, {"op": "DeclareIndex", **x.__dict__})
        self.indexes[name] = x
        return x

    def drop_index(self, name: str) -> None:
        """Drop an index; the constraint of a unique one goes with it unless another index needs it."""
        if name not in self.indexes:
            raise NotFound(f"no index {name}")
        x = self.indexes[name]
        self._change_schema(self.catalog, {"op": "DropIndex", "name": name})
        del self.indexes[name]
        self._built.pop(name, None)
        c = Constraint("unique", x.label or "", x.key, x.owner).name
        if x.unique and c in self.constraints and not any(y.unique and (y.label, y.key, y.owner) == (x.label, x.key, x.owner) for y in self.indexes.values()):
            self.drop_constraint(c)

    def get_index(self, name: str) -> Any:
        """The index's entries (``PropertyIndex``), brought up to the version its mode asks for."""
        from .operators.index import PropertyIndex

        if name not in self.indexes:
            raise NotFound(f"no index {name}")
        x, had = self.indexes[name], self._built.get(name)
        if had is not None and (had[0] == self.version.lsn or x.mode == "deferred"):
            return had[1]
        i = "vid" if x.owner == "node" else "eid"
        df = self.version.nodes if x.owner == "node" else self.version.edges
        labels = (x.label,) if x.label else ()
        touched = None if had is None or x.mode != "incremental" else self._touched_since(had[0], i)
        if touched is None:
            made = PropertyIndex.of_table(df, x.key, i, labels, f"{scratch(self.spark, 'index')}/t")
        else:
            made = had[1].updated(PropertyIndex.of_table(df.filter(F.col(i).isin(touched)), x.key, i, labels), touched)
        self._built[name] = (self.version.lsn, made)
        if self.on_index_size is not None and made.path:
            self.on_index_size(name, Files(self.spark, made.path).fs.getContentSummary(self.journal.files.where(made.path)).getLength())
        return made

    def _touched_since(self, lsn: int, i: str) -> list[int] | None:
        """Ids that single changes after ``lsn`` touched; None if there were others, or many."""
        if lsn < self._base.lsn:
            return None
        ids = {o[i] for at, o in self._ops if at > lsn and o.get(i) is not None}
        return sorted(ids) if len(ids) <= 1000 else None

    def flush_indexes(self) -> None:
        """Bring deferred indexes up to the present version."""
        for n, x in self.indexes.items():
            if x.mode == "deferred":
                self._built.pop(n, None)
                self.get_index(n)

    def list_indexes(self) -> list[Index]:
        return sorted(self.indexes.values(), key=lambda x: x.name)

    def list_constraints(self) -> list[Constraint]:
        return sorted(self.constraints.values(), key=lambda c: c.name)

    def find(self, key: str, value: Any, label: str | None = None) -> DataFrame:
        """(vid), ascending, of nodes whose ``key`` equals ``value``: by an index of the key that is up to date, else by a scan."""
        for n, x in self.indexes.items():
            if x.owner == "node" and x.key == key and x.label in (None, label) and value is not None and self.catalog.node_keys.get(key) == type_of(value) and self._built.get(n, (None,))[0] == self.version.lsn:
                hit = self._built[n][1].equal(value)
                if label and x.label != label:
                    hit = hit.join(self.view.nodes((label,)), "vid", "left_semi")
                return hit.orderBy("vid")
        from .api import find_nodes

        return find_nodes(self.view, key, value, label)

    def _check(self, v: Version, constraints: Sequence[Constraint], touched: Mapping[str, DataFrame] | None = None) -> None:
        """Raise if a constraint is violated; with ``touched`` (ids by owner) only by entities among them."""
        from .operators.constraints import existence_violations, unique_violations

        for c in constraints:
            df, i = (v.nodes, "vid") if c.owner == "node" else (v.edges, "eid")
            near = df if touched is None else df.join(touched[c.owner], i, "left_semi")
            if c.kind == "exists":
                bad = existence_violations(near, c.label, c.key, i)
            else:
                if touched is not None and column(c.key) in df.columns:
                    df = df.join(near.select(column(c.key)).distinct(), column(c.key), "left_semi")  # only values that were written
                bad = unique_violations(df, c.label, c.key)
            if (row := bad.limit(1).collect()):
                raise ConstraintViolation(f"{c.name}: {row[0].asDict()}")

    def _concerned(self, keys: Mapping[str, set[str]], new: set[str]) -> list[Constraint]:
        """Constraints that writes to ``keys`` (by owner), or entities that are ``new`` or relabelled, can violate."""
        return [c for c in self.constraints.values() if c.owner in new or c.key in keys.get(c.owner, ())]

    # -- transactions
    def _writable(self) -> None:
        if self.closed:
            raise GraphClosed("the graph is closed")

    def transact(self, body: Callable[[Txn], Any], capture_prev: bool = False, durability: str = "fsync") -> Any:
        """Run ``body`` with a transaction; commit when it returns, drop everything if it raises.

        With a ``durability`` other than fsync the commit may be held back, and lost in a crash, until
        ``flush``, ``close``, a checkpoint, a commit that is durable, or ``GROUP`` such commits.
        """
        self._writable()
        if durability not in DURABILITY:
            raise DataError(f"unknown durability {durability}")
        t = Txn(self)
        out = body(t)
        if t.ops:
            self._commit(t.ops, capture_prev, durability)
        return out

    def _commit(self, ops: list[dict], capture_prev: bool = False, durability: str = "fsync") -> None:
        """Check the whole batch, write the log, then apply it: all or nothing."""
        cat = self.catalog.copy()
        for o in ops:
            owner = "edge" if "Edge" in o["op"] else "node"
            for x in o.get("labels") or ():
                cat.intern_label(x)
            if "type" in o:
                cat.intern_edge_type(o["type"])
            if o["op"] in ("AddNode", "AddEdge"):
                o["props"] = {k: cat.fit(owner, k, v) for k, v in o["props"].items()}
            elif o["op"].startswith("Set") and "key" in o:
                o["value"] = cat.fit(owner, o["key"], o["value"])
        self._check_there(ops)
        self._check_ids(ops)
        at = self.version.lsn + 1
        v = self._applied([*self._ops, *((at, o) for o in ops)], cat)
        touched = {"node": {o["vid"] for o in ops if o.get("vid") is not None}, "edge": {o["eid"] for o in ops if o.get("eid") is not None}}
        keys = {w: {o["key"] for o in ops if "key" in o and ("Edge" in o["op"]) == (w == "edge")} for w in ("node", "edge")}
        new = {w for w, kinds in (("node", ("AddNode", "SetNodeLabels")), ("edge", ("AddEdge",))) if any(o["op"] in kinds for o in ops)}
        if concerned := self._concerned(keys, new):
            self._check(v, concerned, {w: self.spark.createDataFrame([(x,) for x in ids], f"{'vid' if w == 'node' else 'eid'} long") for w, ids in touched.items()})
        stripped = [o["vid"] for o in ops if o["op"] == "SetNodeLabels" and o["removed"]]
        if stripped and (bad := v.nodes.filter(F.col("vid").isin(stripped) & (F.size("labels") == 0)).select("vid").limit(1).collect()):
            raise DataError(f"node {bad[0].vid} would lose its last label")
        lsn = self._log_ops(ops, capture_prev, _new_names(self.catalog, cat), durability)
        self._ops += [(lsn, o) for o in ops]
        self.version = Version(v.nodes, v.edges, v.catalog, lsn, v.deltas)
        if len(self._ops) >= FOLD_OPS:
            self.merge_now()
        self._checkpoint_if_due()

    def _check_there(self, ops: list[dict]) -> None:
        """Entities that ops name must be there; deleting what isn't there changes nothing."""
        need = lambda o: {"AddEdge": {("node", o.get("src")), ("node", o.get("dst"))}, **dict.fromkeys(("SetNodeProp", "SetNodeLabels", "DelNodeProp"), {("node", o.get("vid"))}), **dict.fromkeys(("SetEdgeProp", "DelEdgeProp"), {("edge", o.get("eid"))})}.get(o["op"], set())
        ends = {o["eid"]: {o["src"], o["dst"]} for o in ops if o["op"] == "AddEdge"}
        new = {("node", o["vid"]) for o in ops if o["op"] == "AddNode"} | {("edge", e) for e in ends}
        asked = {x for o in ops for x in need(o)} - new
        edges = self._rows({i for w, i in asked if w == "edge"}, "edge")
        there = {("node", r.vid) for r in self._rows({i for w, i in asked if w == "node"}, "node")} | {("edge", r.eid) for r in edges} | set()
        ends |= {r.eid: {r.src, r.dst} for r in edges}
        gone: set = set()
        made: set = set()
        for o in ops:
            for w, i in need(o):
                if (w, i) in gone or not ((w, i) in there or (w, i) in made):
                    raise NotFound(f"{o['op']}: no {w} {i}")
                if w == "edge" and any(("node", x) in gone for x in ends.get(i, ())):
                    raise NotFound(f"{o['op']}: edge {i} went with its node")
            if o["op"] == "AddNode":
                made.add(("node", o["vid"]))
            elif o["op"] == "AddEdge":
                made.add(("edge", o["eid"]))
            elif o["op"] in ("DelNode", "DelEdge"):
                gone.add(("node", o["vid"]) if o["op"] == "DelNode" else ("edge", o["eid"]))

    def _rows(self, ids: set[int], owner: str) -> list:
        if not ids:
            return []
        i, df, cols = ("vid", self.version.nodes, ["vid"]) if owner == "node" else ("eid", self.version.edges, ["eid", "src", "dst"])
        return df.join(self.spark.createDataFrame([(x,) for x in ids], f"{i} long"), i, "left_semi").select(*cols).collect()  # as many as the transaction names

    def _check_ids(self, ops: list[dict]) -> None:
        ids = [o["logical_id"] for o in ops if o["op"] == "AddNode"]
        if len(set(ids)) < len(ids):
            raise ConstraintViolation("a logical id is given twice")
        if ids and (x := self.version.nodes.join(self.spark.createDataFrame([(i,) for i in ids], "logical_id string"), "logical_id", "left_semi").select("logical_id").limit(1).collect()):
            raise ConstraintViolation(f"logical id {x[0][0]} exists")

    def _applied(self, ops: Iterable[tuple[int, dict]], cat: Catalog) -> Version:
        """The base with all single changes since. Those of one entity are folded on the driver: they fit there."""
        nodes: dict[int, dict] = {}
        edges: dict[int, dict] = {}
        for _, o in ops:
            if o["op"] == "AddNode":
                nodes[o["vid"]] = {"new": o, "props": dict(o["props"]), "labels": set(o["labels"]), "removed": set()}
            elif o["op"] == "AddEdge":
                edges[o["eid"]] = {"new": o, "props": dict(o["props"])}
            elif o["op"] == "DelNode":
                nodes[o["vid"]] = {"gone": True}
                for e in [k for k, x in edges.items() if "new" in x and o["vid"] in (x["new"]["src"], x["new"]["dst"])]:
                    del edges[e]
            elif o["op"] == "DelEdge":
                edges[o["eid"]] = {"gone": True}
            elif o["op"] == "SetNodeLabels":
                n = nodes.setdefault(o["vid"], {"props": {}})
                n.setdefault("props", {})
                n["labels"] = (n.get("labels", set()) - set(o["removed"])) | set(o["labels"])
                n["removed"] = (n.get("removed", set()) | set(o["removed"])) - set(o["labels"])
            else:
                d, i = (edges, o["eid"]) if "Edge" in o["op"] else (nodes, o["vid"])
                e = d.setdefault(i, {"props": {}})
                e.setdefault("props", {})[o["key"]] = o["value"] if o["op"].startswith("Set") else _ABSENT
        v = self._base
        gone = [k for k, x in nodes.items() if x.get("gone")]
        new_nodes = self._merge(v.nodes, "vid", nodes, cat.node_keys, NODE)
        new_edges = self._merge(v.edges, "eid", edges, cat.edge_keys, EDGE)
        if gone:
            new_edges = without_nodes(new_edges, self.spark.createDataFrame([(x,) for x in gone], "vid long"))
        return Version(new_nodes, new_edges, cat, v.lsn, v.deltas)

    def _merge(self, base: DataFrame, key: str, changes: Mapping[int, dict], keys: Mapping[str, str], schema: str) -> DataFrame:
        base = with_columns(base, keys)
        gone = [k for k, x in changes.items() if x.get("gone")]
        if gone:
            base = base.join(self.spark.createDataFrame([(x,) for x in gone], f"{key} long"), key, "left_anti")
        changed = {k: x for k, x in changes.items() if "new" not in x and not x.get("gone")}
        if changed:
            touched = sorted({p for x in changed.values() for p in x.get("props", {})})
            fields = ", ".join([f"{key} long", "`\x1fset` array<string>", "`\x1foff` array<string>", "`\x1fon` array<string>", "`\x1fnull` array<string>", *[f"`\x1f{p}` {TYPES[keys[p]]}" if p in keys else f"`\x1f{p}` string" for p in touched]])
            rows = [(k, list(x.get("props", {})), sorted(x.get("removed", ())), sorted(x.get("labels", ())), [p for p, w in x.get("props", {}).items() if w is None], *[None if x.get("props", {}).get(p) in (None, _ABSENT) else x["props"][p] for p in touched]) for k, x in changed.items()]
            d = self.spark.createDataFrame(rows, fields)
            j = base.join(d, key, "left")
            hit = F.col("\x1fset").isNotNull()
            cols = {}
            for p in touched:
                if p in keys:
                    cols[column(p)] = F.when(F.array_contains("\x1fset", p), F.col(f"`\x1f{p}`")).otherwise(F.col(f"`{column(p)}`"))
            none = F.array().cast("array<string>")
            cols["null_keys"] = F.when(hit, F.array_union(F.array_except(F.coalesce("null_keys", none), "\x1fset"), "\x1fnull")).otherwise(F.col("null_keys"))
            if "labels" in base.columns:
                cols["labels"] = F.when(hit, F.array_sort(F.array_union(F.array_except("labels", "\x1foff"), "\x1fon"))).otherwise(F.col("labels"))
            base = j.select(*[cols.get(c, F.col(f"`{c}`")).alias(c) for c in base.columns])
        added = [(k, x) for k, x in changes.items() if "new" in x]
        if added:
            names = [c.strip().split(" ")[0] for c in schema.split(",")]
            full = schema + "".join(f", `{column(k)}` {TYPES[t]}" for k, t in keys.items())
            rows = []
            for _, x in added:
                o = {**x["new"], "labels": sorted(x["labels"]) if "labels" in x else None, "null_keys": [p for p, w in x["props"].items() if w is None]}
                rows.append((*[o.get(n) for n in names], *[None if x["props"].get(k) is _ABSENT else x["props"].get(k) for k in keys]))
            base = base.unionByName(self.spark.createDataFrame(rows, full))
        return base

    def _log_ops(self, ops: list[dict], capture_prev: bool, schema: list[dict], durability: str) -> int:
        prev = self._previous(ops) if capture_prev else {}
        flat = []
        for o in ops:  # the properties an entity is added with follow as records of their own
            flat.append({k: w for k, w in o.items() if k != "props"})
            for k, w in o.get("props", {}).items():
                flat.append({"op": o["op"].replace("Add", "Set") + "Prop", "vid": o.get("vid"), "eid": o.get("eid"), "key": k, "value": w})
        for r in flat:
            if r["op"] in ("SetNodeProp", "SetEdgeProp"):
                r["prev_value"] = prev.get((r.get("vid"), r.get("eid"), r["key"]))
                r["value"] = json.dumps(r["value"])
        self.txn += 1
        self._waiting.append((self.txn, self.version.lsn + 1, flat, schema))
        if durability == "fsync" or len(self._waiting) >= GROUP:
            self.flush()
        return self.version.lsn + len(flat) + 2

    def flush(self) -> None:
        """Write the commits that were held back."""
        while self._waiting:
            txn, lsn, records, schema = self._waiting[0]
            self.journal.append(txn, lsn, records, schema)
            del self._waiting[0]

    def _previous(self, ops: list[dict]) -> dict:
        out = {}
        for owner, df, key in (("node", self.version.nodes, "vid"), ("edge", self.version.edges, "eid")):
            want = {(o[key], o["key"]) for o in ops if o["op"] == ("SetNodeProp" if owner == "node" else "SetEdgeProp")}
            if not want:
                continue
            ids = self.spark.createDataFrame([(i,) for i in {w[0] for w in want}], f"{key} long")
            for r in df.join(ids, key, "left_semi").collect():
                d = r.asDict()
                for i, k in want:
                    if i == d[key] and column(k) in d:
                        out[(i, None, k) if owner == "node" else (None, i, k)] = json.dumps(d[column(k)])
        return out

    def _rebase(self, v: Version) -> None:
        """Go on from a version that no single changes lie on."""
        self._base, self._ops, self.version = v, [], v
        if v.deltas >= FOLD_AFTER:
            self.merge_now()

    def merge_now(self) -> None:
        """Fold what was written since: write the effective tables and go on from there."""
        path = scratch(self.spark, "fold")
        v = self.version
        for name, df in (("nodes", v.nodes), ("edges", v.edges)):
            df.write.parquet(f"{path}/{name}")
        self._rebase(Version(self.spark.read.schema(v.nodes.schema).parquet(f"{path}/nodes"), self.spark.read.schema(v.edges.schema).parquet(f"{path}/edges"), v.catalog, v.lsn, 0))

    # -- bulk
    def bulk_add_edges(self, edges: DataFrame, edge_type: str) -> int:
        """Append edges (src, dst) of one type without properties; every end must exist. Returns their number."""
        self._writable()
        _no_dangling(edges, self.version.nodes)
        cat = self.catalog.copy()
        cat.intern_edge_type(edge_type)
        new = edges.select("src", "dst").withColumn("eid", F.monotonically_increasing_id() + self.next_eid)
        rows = new.select(F.lit("AddEdge").alias("op"), "eid", "src", "dst", F.lit(edge_type).alias("type"), F.uuid().alias("logical_id"))
        log, m = self._log_rows(rows, cat)
        add = log.select("eid", "logical_id", "src", "dst", "type").withColumn("null_keys", F.array().cast("array<string>"))
        v = self.version
        self._rebase(Version(v.nodes, with_columns(v.edges, cat.edge_keys).unionByName(with_columns(add, cat.edge_keys)), cat, m["commit_lsn"], v.deltas + 1))
        self._checkpoint_if_due()
        return m["n"]

    def bulk_import(self, nodes: DataFrame, edges: DataFrame | None = None) -> tuple[int, int]:
        """Add nodes (logical_id, labels, p_<key>...) and edges (src, dst: logical ids, type, p_<key>...) as one transaction.

        Ends may be nodes of the graph or of the import. Null values are not set. A logical id that is
        null, given twice or there already, a node without labels, and an end that names no node are
        errors, and then nothing is imported. Returns the numbers of nodes and edges.
        """
        from .replay import apply_log
        from .session import written

        self._writable()
        cat = self.catalog.copy()
        back = {"bigint": "int", "int": "int", "double": "double", "boolean": "bool", "string": "string"}

        def keys(df: DataFrame, owner: str) -> list[str]:
            out = []
            for c, t in df.dtypes:
                if c.startswith("p_"):
                    cat.declare(owner, c[2:], back.get(t) or "")
                    out.append(c[2:])
            return out

        def sets(df: DataFrame, i: str, names: Sequence[str], op: str) -> list[DataFrame]:
            out = []
            for k in names:
                v = F.to_json(F.struct(F.col(f"`{column(k)}`").alias("v")))
                out.append(df.filter(F.col(f"`{column(k)}`").isNotNull()).select(F.lit(op).alias("op"), i, F.lit(k).alias("key"), F.substring(v, F.lit(6), F.length(v) - 6).alias("value")))
            return out

        nk = keys(nodes, "node")
        n = written(nodes.select("logical_id", F.array_sort(F.array_distinct("labels")).alias("labels"), *[f"`{column(k)}`" for k in nk]).withColumn("vid", F.monotonically_increasing_id() + self.next_vid), "import")
        if n.filter("logical_id is null or coalesce(size(labels), 0) <= 0").limit(1).count():
            raise DataError("an imported node has no logical id or no label")
        ids = n.select("logical_id", "vid").unionByName(self.version.nodes.select("logical_id", "vid"))
        if n.groupBy("logical_id").count().filter("count > 1").limit(1).count() or n.join(self.version.nodes, "logical_id", "left_semi").limit(1).count():
            raise ConstraintViolation("an imported logical id is given twice or exists")
        parts = [n.select(F.lit("AddNode").alias("op"), "vid", "logical_id", "labels"), *sets(n, "vid", nk, "SetNodeProp")]
        for r in n.select(F.explode("labels").alias("l")).distinct().orderBy("l").collect():  # names, not rows
            cat.intern_label(r.l)
        if edges is not None:
            ek = keys(edges, "edge")
            e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), "type", *[f"`{column(k)}`" for k in ek])
            for end, to in (("s", "src"), ("d", "dst")):
                e = e.join(ids.select(F.col("logical_id").alias(end), F.col("vid").alias(to)), end, "left")
            e = written(e.withColumn("eid", F.monotonically_increasing_id() + self.next_eid), "import")
            if e.filter("src is null or dst is null or type is null").limit(1).count():
                raise NotFound("an imported edge names no node or no type")
            parts += [e.select(F.lit("AddEdge").alias("op"), "eid", "src", "dst", "type", F.uuid().alias("logical_id")), *sets(e, "eid", ek, "SetEdgeProp")]
            for r in e.select("type").distinct().orderBy("type").collect():
                cat.intern_edge_type(r.type)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p, allowMissingColumns=True)
        _, m = self._apply_rows(rows, cat, {"node": set(nk), "edge": set(cat.edge_keys)}, {"node", "edge"}, apply_log)
        return m["nodes"], m["edges"]

    def _apply_rows(self, rows: DataFrame, cat: Catalog, keys: Mapping[str, set[str]], new: set[str], apply_log: Callable) -> tuple[Version, dict]:
        """Log rows of DataFrame size, check what they touch, and go on from the version after them."""
        before = self.txn
        log, m = self._log_rows(rows, cat)
        v = apply_log(self.version, log, cat)
        try:
            if concerned := self._concerned(keys, new):
                self._check(v, concerned, {"node": log.select("vid").filter("vid is not null").distinct(), "edge": log.select("eid").filter("eid is not null").distinct()})
        except ConstraintViolation:
            self.journal.files.remove(self.journal.folder(self.txn))
            self.txn = before
            raise
        self._rebase(Version(v.nodes, v.edges, cat, m["commit_lsn"], self.version.deltas + 1))
        self._checkpoint_if_due()
        return v, m

    def add_edge_if_absent(self, src: int, dst: int, edge_type: str) -> int | None:
        """Add an edge unless one of the type runs from ``src`` to ``dst``; its id, or None."""
        e = self.version.edges
        if e.filter((F.col("src") == src) & (F.col("dst") == dst) & (F.col("type") == edge_type)).limit(1).count():
            return None
        return self.transact(lambda t: t.add_edge(src, dst, edge_type))

    def replace_edge(self, src: int, dst: int, edge_type: str) -> int:
        """Make ``src`` -> ``dst`` the only edge of the type that leaves ``src``, in one transaction."""
        old = [r.eid for r in self.version.edges.filter((F.col("src") == src) & (F.col("type") == edge_type)).select("eid").collect()]

        def body(t: Txn) -> int:
            for eid in old:
                t.del_edge(eid)
            return t.add_edge(src, dst, edge_type)

        return self.transact(body)

    def _log_rows(self, rows: DataFrame, cat: Catalog) -> tuple[DataFrame, dict]:
        self.flush()
        log, m = self.journal.append_frame(self.txn + 1, self.version.lsn + 1, rows, _new_names(self.catalog, cat))
        self.txn += 1
        if m["vid"] is not None and m["nodes"]:
            self.next_vid = max(self.next_vid, m["vid"] + 1)
        if m["eid"] is not None and m["edges"]:
            self.next_eid = max(self.next_eid, m["eid"] + 1)
        return log, m

    # -- query language
    def _mutate(self, s: Statement, params: Mapping[str, Any], strict: bool) -> DataFrame:
        """Match on this version, compute all changes from it, commit them together, then RETURN from the next."""
        plan = Planner(self.view, Statement("match", s.patterns, s.where, s.mutations, None), params, strict)
        rows = Rows(plan)
        cat = self.catalog.copy()
        parts = []
        for m in s.mutations:
            kind = plan.kinds.get(m[1])
            if kind is None:
                raise PlanError(f"{m[1]} is not bound")
            i = "vid" if kind == "node" else "eid"
            if m[0] == "delete":
                parts.append(rows.df.select(F.col(rows.id(m[1])).alias(i)).distinct().withColumn("op", F.lit("DelNode" if kind == "node" else "DelEdge")))
                continue
            c, t = rows.eval(m[3])
            if t not in (*TYPES, "null"):
                raise SchemaError(f"a property can't hold {t}")
            if t != "null":
                have = cat.keys(kind).get(m[2])
                if have is None:
                    cat.declare(kind, m[2], t)
                elif have != t and not (have == "double" and t == "int"):
                    raise SchemaError(f"{kind} property {m[2]!r} is {have}, not {t}")
            want = TYPES.get(cat.keys(kind).get(m[2], ""), "string")
            # of several rows for one entity the greatest value counts
            value = rows.df.select(F.col(rows.id(m[1])).alias(i), c.cast(want).alias("v")).groupBy(i).agg(F.max("v").alias("v"))
            text = F.coalesce(F.to_json(F.struct("v"), {"ignoreNullFields": "false"}), F.lit('{"v":null}'))
            parts.append(value.select(i, F.lit("SetNodeProp" if kind == "node" else "SetEdgeProp").alias("op"), F.lit(m[2]).alias("key"), F.substring(text, F.lit(6), F.length(text) - 6).alias("value")))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p, allowMissingColumns=True)
        from .replay import apply_log

        written = {w: {m[2] for m in s.mutations if m[0] == "set" and plan.kinds[m[1]] == w} for w in ("node", "edge")}
        self._apply_rows(both, cat, written, set(), apply_log)
        if s.returns is None:
            return self.spark.range(0).select()
        again = Statement("match", s.patterns, s.where, [], s.returns, s.distinct, s.order, s.skip, s.limit)
        return Rows(Planner(self.view, again, params, strict)).result()

    def _constants(self, exprs: Sequence[Any], params: Mapping[str, Any]) -> list[Any]:
        """Values of expressions that name nothing bound."""
        if not exprs:
            return []
        r = Rows.__new__(Rows)
        r.plan = type("P", (), {"kinds": {}, "params": params, "strict": False, "view": self.view})()
        r.view = self.view
        cols = [r.eval(e) for e in exprs]
        row = self.spark.range(1).select(*[c.cast("string" if t == "null" else TYPES.get(t, "string")).alias(f"c{i}") for i, (c, t) in enumerate(cols)]).first()
        return list(row)

    def _create(self, s: Statement, params: Mapping[str, Any]) -> DataFrame:
        p = s.patterns[0]
        exprs = [e for x in (*p.nodes, *p.rels) for e in x.props.values()]
        values = iter(self._constants(exprs, params))
        props = {id(x): {k: next(values) for k in x.props} for x in (*p.nodes, *p.rels)}
        for n in p.nodes:
            if not n.labels:
                raise PlanError("a created node needs a label")
        for r in p.rels:
            if len(r.types) != 1 or r.hops is not None:
                raise PlanError("a created edge needs one type")
        ids: dict[str, tuple[str, int]] = {}
        if s.kind == "merge" and (found := self._find(p.nodes[0].labels, props[id(p.nodes[0])])) is not None:
            ids[p.nodes[0].alias or " "] = ("node", found)
        else:

            def body(t: Txn) -> None:
                vids = []
                for n in p.nodes:
                    vids.append(t.add_node(n.labels, props[id(n)]))
                    ids[n.alias or f" {len(vids)}"] = ("node", vids[-1])
                for i, r in enumerate(p.rels):
                    a, b = (vids[i + 1], vids[i]) if r.direction == "in" else (vids[i], vids[i + 1])
                    eid = t.add_edge(a, b, r.types[0], props[id(r)])
                    ids[r.alias or f" r{i}"] = ("edge", eid)

            self.transact(body)
        if s.returns is None:
            return self.spark.range(0).select()
        return self._returned(s, ids, params)

    def _find(self, labels: Sequence[str], props: Mapping[str, Any]) -> int | None:
        if any(x not in self.catalog.labels for x in labels) or any(k not in self.catalog.node_keys and v is not None for k, v in props.items()):
            return None
        df = self.view.nodes(labels, [k for k in props if k in self.catalog.node_keys])
        for k, v in props.items():
            if k in self.catalog.node_keys:
                df = df.filter(F.col(f"`{column(k)}`").eqNullSafe(literal(v)[0]))
        row = df.agg(F.min("vid")).first()
        return row[0]

    def _returned(self, s: Statement, ids: Mapping[str, tuple[str, int]], params: Mapping[str, Any]) -> DataFrame:
        """RETURN of CREATE and MERGE: one row; columns without alias are numbered."""
        r = Rows.__new__(Rows)
        kinds = {k: kind for k, (kind, _) in ids.items()}
        items = [Item(it.expr, it.alias or f"col{i}") for i, it in enumerate(s.returns or [])]
        plan = Planner.__new__(Planner)
        plan.view, plan.stmt, plan.params, plan.strict = self.view, Statement("match", [], returns=items, distinct=s.distinct), params, False
        plan.kinds, plan.needs, plan.wants_labels, plan.tell = kinds, {k: set() for k in kinds}, set(), lambda d: None
        plan._find_needs()
        r.plan, r.view = plan, self.view
        df = self.spark.range(1)
        for a, (kind, i) in ids.items():
            keys = sorted(plan.needs[a])
            df = df.withColumn(r.id(a), F.lit(i).cast("long"))
            if keys or a in plan.wants_labels:
                src = self.view.nodes((), keys, a in plan.wants_labels).withColumnRenamed("vid", "\x1fkey") if kind == "node" else self.view.edges(None, keys).withColumnRenamed("eid", "\x1fkey")
                cols = [F.col(f"`{column(k)}`").alias(r.prop(a, k)) for k in keys] + ([F.array_sort("labels").alias(r.labels(a))] if a in plan.wants_labels else [])
                df = df.join(src.select("\x1fkey", *cols), F.col(r.id(a)) == F.col("\x1fkey")).drop("\x1fkey")
        r.df = df
        return r.result()

    # -- checkpoint
    def checkpoint(self) -> None:
        """Store the effective tables under the graph's path, write a manifest, drop the log before it.

        Until the manifest is whole the one before it counts, with the log that follows it.
        """
        self.flush()
        name = f"{self.version.lsn:019d}-{uuid.uuid4().hex[:8]}"
        self._store(name)
        c = self.catalog
        self._point({"version": name, "lsn": self.version.lsn, "txn": self.txn, "next_vid": self.next_vid, "next_eid": self.next_eid, "node_keys": c.node_keys, "edge_keys": c.edge_keys, "labels": c.labels, "edge_types": c.edge_types, "linked": self.linked, "constraints": [x.__dict__ for x in self.constraints.values()], "indexes": [x.__dict__ for x in self.indexes.values()]})
        base = f"{self.path}/versions/{name}"
        self._rebase(Version(self.spark.read.parquet(f"{base}/nodes"), self.spark.read.parquet(f"{base}/edges"), c, self.version.lsn, 0))
        self._drop_before(name)

    def _store(self, name: str) -> None:
        for part, df in (("nodes", self.version.nodes), ("edges", self.version.edges)):
            df.write.parquet(f"{self.path}/versions/{name}/{part}")

    def _point(self, manifest: dict) -> None:
        self.journal.manifests.write(manifest)

    def _drop_before(self, name: str) -> None:
        """The log up to the manifest, and versions older than the one before it unless a pin may read them."""
        self.journal.truncate(self.txn)
        old = [v for v in self.journal.files.names(f"{self.path}/versions") if v != name]
        for v in old[:-1]:
            if not self.pins:
                self.journal.files.remove(f"{self.path}/versions/{v}")

    def checkpoint_every(self, commits: int | None = None, size: int | None = CHECKPOINT_BYTES) -> None:
        """Checkpoint by itself once the log holds so many commits or bytes."""
        self.checkpoint_commits, self.checkpoint_bytes = commits, size

    def _checkpoint_if_due(self) -> None:
        if self.checkpoint_commits is None and self.checkpoint_bytes is None:
            return
        n, size = self.journal.size()
        if (self.checkpoint_commits is not None and n >= self.checkpoint_commits) or (self.checkpoint_bytes is not None and size >= self.checkpoint_bytes):
            self.checkpoint()


_ABSENT = object()


def _replace(v: Version, **changes: Any) -> Version:
    return Version(**{**v.__dict__, **changes})


def _new_names(old: Catalog, new: Catalog) -> list[dict]:
    """Changes of the schema that lead from one catalogue to the next, in order."""
    out: list[dict] = []
    for kind, a, b in (("label", old.labels, new.labels), ("edgeType", old.edge_types, new.edge_types)):
        out += [{"op": "InternString", "kind": kind, "id": i, "name": b[i]} for i in range(len(a), len(b))]
    for owner in ("node", "edge"):
        out += [{"op": "DeclareColumn", "owner": owner, "key": k, "type": t} for k, t in new.keys(owner).items() if k not in old.keys(owner)]
    return out


def _no_dangling(edges: DataFrame, nodes: DataFrame) -> None:
    """Both ends of every edge must be nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vid"))
    if lost := ends.join(nodes.select("vid"), "vid", "left_anti").limit(1).collect():
        raise NotFound(f"no node {lost[0][0]}")


def with_columns(df: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """``df`` with a column for every key."""
    return df.select("*", *[F.lit(None).cast(TYPES[t]).alias(column(k)) for k, t in keys.items() if column(k) not in df.columns])


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges none of whose ends is among the nodes ``gone`` (vid)."""
    return edges.join(gone.select(F.col("vid").alias("src")), "src", "left_anti").join(gone.select(F.col("vid").alias("dst")), "dst", "left_anti").select(*edges.columns)


def typed_value(text: Column, t: str) -> Column:
    """A logged JSON value as a column of type ``t``."""
    return F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {TYPES[t]}")["v"]


__all__ = ["LOG", "SCHEMA_OPS", "Constraint", "Graph", "Index", "Pin", "Txn", "Version", "box", "type_of"]
