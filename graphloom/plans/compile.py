"""From the syntax tree to a DataFrame.

The planner names every alias, finds the properties each needs, and lists the steps; each step adds
joins and columns to one DataFrame, and Catalyst does the rest. A part of WHERE is applied as soon as
the aliases it names are bound, which matters for variable-length walks. The node at an edge's end
is joined only if its labels aren't known from the edge or its properties are used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError, PlanError
from ..functions import scalars as sc
from ..model import GraphView, column
from .syntax import AGGREGATES, Binary, Call, IsNull, Item, ListLit, Lit, NodePattern, Param, Pattern, Prop, RelPattern, Statement, Unary, Var
from .walk import reach, reach_counts


@dataclass(frozen=True)
class Diagnostic:
    severity: str
    message: str
    hint: str = ""


@dataclass
class Step:
    what: str
    detail: dict[str, Any] = field(default_factory=dict)

    def __str__(self) -> str:
        return f"{self.what}({', '.join(f'{k}={v}' for k, v in self.detail.items() if v not in (None, [], {}))})"


def children(e: Any) -> tuple:
    if isinstance(e, Binary):
        return e.a, e.b
    if isinstance(e, (Unary, IsNull)):
        return (e.x,)
    if isinstance(e, Prop):
        return (e.base,)
    if isinstance(e, Call):
        return e.args
    if isinstance(e, ListLit):
        return e.items
    return ()


def walk(e: Any):  # noqa: ANN201
    yield e
    for c in children(e):
        yield from walk(c)


def has_aggregate(e: Any) -> bool:
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def conjuncts(e: Any) -> list:
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.a) + conjuncts(e.b)
    return [] if e is None else [e]


def column_name(item: Item, i: int) -> str:
    if item.alias:
        return item.alias
    e = item.expr
    if isinstance(e, Var):
        return e.name
    if isinstance(e, Prop) and isinstance(e.base, Var):
        return f"{e.base.name}.{e.key}"
    if isinstance(e, Call):
        if e.star:
            return f"{e.name}(*)"
        inner = ", ".join(column_name(Item(a, None), -1) for a in e.args)
        if "col-1" not in inner:
            return f"{e.name}({inner})"
    return f"col{i}"


class Planner:
    """Names, kinds, needed properties and steps of a MATCH; raises PlanError for what can't be planned."""

    def __init__(self, view: GraphView, stmt: Statement, params: Mapping[str, Any], strict: bool = False, max_hops: int | None = None, tell: Callable[[Diagnostic], None] | None = None) -> None:
        self.view, self.stmt, self.params, self.strict, self.max_hops = view, stmt, params, strict, max_hops
        self.tell = tell or (lambda d: None)
        self.kinds: dict[str, str] = {}
        self.needs: dict[str, set[str]] = {}
        self.wants_labels: set[str] = set()
        self.steps: list[Step] = []
        self._name_patterns()
        self._find_needs()
        self._plan()

    # -- names
    def _name_patterns(self) -> None:
        n = 0
        for p in self.stmt.patterns:
            for x in (*p.nodes, *p.rels):
                if x.alias is None:
                    x.alias = f" {n}"  # no user can spell it
                    n += 1
                kind = "node" if isinstance(x, NodePattern) else "edge"
                if isinstance(x, RelPattern):
                    if x.alias in self.kinds:
                        raise PlanError(f"{x.alias} is bound twice")
                    if x.hops is not None and not x.alias.startswith(" "):
                        raise PlanError("a walk of several edges can't be bound to a name")
                    if x.hops is not None and x.props:
                        raise PlanError("a walk of several edges can't have properties")
                    for t in x.types:
                        if t not in self.view.catalog.edge_types:
                            raise PlanError(f"unknown edge type {t}")
                else:
                    for label in x.labels:
                        if label not in self.view.catalog.labels:
                            raise PlanError(f"unknown label {label}")
                if self.kinds.setdefault(x.alias, kind) != kind:
                    raise PlanError(f"{x.alias} is both a node and an edge")
                self.needs.setdefault(x.alias, set())

    def _find_needs(self) -> None:
        s = self.stmt
        exprs: list[Any] = [s.where, *(i.expr for i in s.returns or []), *(e for e, _ in s.order), *(m[3] for m in s.mutations if m[0] == "set")]
        for p in s.patterns:
            for x in (*p.nodes, *p.rels):
                exprs += [*x.props.values(), *(Prop(Var(x.alias), k) for k in x.props)]
        for e in exprs:
            for x in walk(e) if e is not None else ():
                if isinstance(x, Prop) and isinstance(x.base, Var) and x.base.name in self.kinds:
                    kind = self.kinds[x.base.name]
                    if x.key in self.view.catalog.keys(kind):
                        self.needs[x.base.name].add(x.key)
                    elif x.key == "label" and kind == "node":
                        self.tell(Diagnostic("warning", f"{x.base.name}.label is an ordinary property, which is not set anywhere", f"labels({x.base.name}) gives the labels"))
                elif isinstance(x, Call) and x.name == "LABELS" and isinstance(x.args[0], Var):
                    self.wants_labels.add(x.args[0].name)

    # -- steps
    def _plan(self) -> None:
        left = conjuncts(self.stmt.where)
        bound: set[str] = set()

        def filters() -> None:
            for e in list(left):
                if {x.name for x in walk(e) if isinstance(x, Var)} <= bound:
                    self.steps.append(Step("Filter", {"expr": e}))
                    left.remove(e)

        for k, p in enumerate(self.stmt.patterns):
            first = p.nodes[0]
            start = next((i for i, n in enumerate(p.nodes) if n.alias in bound), None)
            if k and start is None:
                raise PlanError("patterns that share no name would pair every row with every other")
            if start:
                p = self._from(p, start)
                first = p.nodes[0]
            if first.alias in bound:
                if first.labels or first.props:
                    self.steps.append(Step("Restrict", {"node": first}))
            else:
                self.steps.append(Step("NodeScan", {"node": first}))
                bound.add(first.alias)
            filters()
            at = first.alias
            for r, n in zip(p.rels, p.nodes[1:], strict=True):
                self.steps.append(Step("VarLengthExpand" if r.hops is not None else "Expand", {"source": getattr(r, "source", None) or at, "rel": r, "node": n, "again": n.alias in bound}))
                bound |= {n.alias, r.alias}
                at = n.alias
                filters()
        for e in left:
            self.steps.append(Step("Filter", {"expr": e}))
        self._fold_tail()
        self._fold_walk()

    def _fold_tail(self) -> None:
        """Turn the last expands, if nothing names what they bind but how often it is bound, into one count per start.

        Then the number of paths multiplies a weight and never the rows: a hub costs one row an edge.
        """
        s = self.stmt
        exprs = [*(i.expr for i in s.returns or []), *(e for e, _ in s.order)]
        calls = [x for e in exprs for x in walk(e) if isinstance(x, Call) and x.name in AGGREGATES]
        if not calls or s.mutations or any(x.name == "COLLECT" for x in calls):
            return
        used = {x.name for e in [*exprs, s.where] if e is not None for x in walk(e) if isinstance(x, Var)}
        tail: list[Step] = []
        while self.steps and self.steps[-1].what == "Expand":
            d = self.steps[-1].detail
            if d["again"] or {d["rel"].alias, d["node"].alias} & used or (tail and tail[0].detail["source"] != d["node"].alias):
                break
            tail.insert(0, self.steps.pop())
        # an expand that something else starts from, or that only binds what is counted, stays as it is
        if tail and not any(x.detail.get("source") == tail[-1].detail["node"].alias for x in self.steps):
            self.steps.append(Step("CountTail", {"tail": tail}))
        else:
            self.steps += tail

    def _fold_walk(self) -> None:
        """Turn a walk at the end, if nothing is named of its ends but their labels, into counts per start and labels."""
        s = self.stmt
        exprs = [*(i.expr for i in s.returns or []), *(e for e, _ in s.order)]
        calls = [x for e in exprs for x in walk(e) if isinstance(x, Call) and x.name in AGGREGATES]
        last = self.steps[-1]
        if not calls or s.mutations or any(x.name not in ("COUNT", "MIN", "MAX") for x in calls) or last.what != "VarLengthExpand" or last.detail["again"]:
            return
        uses = lambda e: [e.name] if isinstance(e, Var) else [] if isinstance(e, Call) and e.name == "LABELS" and isinstance(e.args[0], Var) else [n for c in children(e) for n in uses(c)]
        if last.detail["node"].alias not in (n for e in exprs for n in uses(e)) and not any(x.name == "LABELS" for c in calls for x in walk(c) if isinstance(x, Call)):
            self.steps[-1] = Step("CountWalk", {k: v for k, v in last.detail.items() if k != "again"})

    @staticmethod
    def _from(p: Pattern, start: int) -> Pattern:
        """The pattern walked from a node that is bound: to its right, then to its left."""
        if start == len(p.nodes) - 1:
            return Pattern(p.nodes[::-1], [_turned(r) for r in p.rels[::-1]])
        raise PlanError("a further pattern has to begin or end at a name that is bound")

    def explain(self) -> str:
        return "\n".join(map(str, self.steps))


def _turned(r: RelPattern) -> RelPattern:
    return RelPattern(r.alias, r.types, r.props, {"in": "out", "out": "in"}.get(r.direction, r.direction), r.hops, r.at)


class Rows:
    """The DataFrame of bindings while the steps are applied."""

    def __init__(self, plan: Planner) -> None:
        self.plan, self.view = plan, plan.view
        self.df: DataFrame | None = None
        self.weight: Column | None = None
        for s in plan.steps:
            getattr(self, "_" + s.what)(**s.detail)

    # columns of an alias, by its number: Spark does not tell names apart that differ in case
    def _number(self, alias: str) -> int:
        return list(self.plan.kinds).index(alias)

    def id(self, alias: str) -> str:
        return f"\x1f{self._number(alias)}\x1fid"

    def prop(self, alias: str, key: str) -> str:
        return f"\x1f{self._number(alias)}\x1fkey\x1f{key}"

    def labels(self, alias: str) -> str:
        return f"\x1f{self._number(alias)}\x1flabels"

    def _scan(self, n: NodePattern) -> DataFrame:
        keys = sorted(self.plan.needs[n.alias])
        # a source without a key that has to equal something that isn't null can give no row
        sure = [k for k, v in n.props.items() if isinstance(v, Lit) and v.value is not None and k in keys]
        df = self.view.nodes(n.labels, keys, n.alias in self.plan.wants_labels, having=sure[0] if sure else None)
        cols = [F.col("vid").alias(self.id(n.alias))] + [F.col(f"`{column(k)}`").alias(self.prop(n.alias, k)) for k in keys]
        if n.alias in self.plan.wants_labels:
            cols.append(F.array_sort("labels").alias(self.labels(n.alias)))
        return df.select(*cols)

    def _restrict_props(self, df: DataFrame, alias: str, props: Mapping[str, Any]) -> DataFrame:
        for k, v in props.items():
            df = df.filter(self.eval(Binary("=", Prop(Var(alias), k), v))[0])
        return df

    def _NodeScan(self, node: NodePattern) -> None:  # noqa: N802
        self.df = self._restrict_props(self._scan(node), node.alias, node.props)

    def _Restrict(self, node: NodePattern) -> None:  # noqa: N802
        if node.labels:
            ids = self.view.nodes(node.labels).select(F.col("vid").alias(self.id(node.alias)))
            self.df = self.df.join(ids, self.id(node.alias), "left_semi")
        self.df = self._restrict_props(self.df, node.alias, node.props)

    def _Filter(self, expr: Any) -> None:  # noqa: N802
        c, t = self.eval(expr)
        if t not in ("bool", "null"):
            raise EvalError(f"WHERE of {t}")
        self.df = self.df.filter(c.cast("boolean"))

    def _directed(self, r: RelPattern, keys: list[str]) -> DataFrame:
        e = self.view.edges(r.types or None, keys)
        there = e.select(F.col("src").alias("\x1ffrom"), F.col("dst").alias("\x1fto"), "eid", *[F.col(f"`{column(k)}`") for k in keys])
        back = e.select(F.col("dst").alias("\x1ffrom"), F.col("src").alias("\x1fto"), "eid", *[F.col(f"`{column(k)}`") for k in keys])
        return {"out": there, "in": back}.get(r.direction) or there.unionByName(back)

    def _join_target(self, node: NodePattern, again: bool, known: set[str]) -> None:
        """The edge's end is in column \x1fto."""
        a = node.alias
        if again:
            self.df = self.df.filter(F.col("\x1fto") == F.col(self.id(a))).drop("\x1fto")
            if node.labels or node.props:
                self._Restrict(node)
            return
        if self.view.closed and set(node.labels) <= known and not self.plan.needs[a] and a not in self.plan.wants_labels:
            self.df = self.df.withColumnRenamed("\x1fto", self.id(a))
        else:
            t = self._restrict_props(self._scan(node), a, node.props)
            self.df = self.df.join(t, F.col("\x1fto") == F.col(self.id(a))).drop("\x1fto")

    def _Expand(self, source: str, rel: RelPattern, node: NodePattern, again: bool) -> None:  # noqa: N802
        keys = sorted(self.plan.needs[rel.alias])
        e = self._directed(rel, keys)
        e = e.select("\x1ffrom", "\x1fto", F.col("eid").alias(self.id(rel.alias)), *[F.col(f"`{column(k)}`").alias(self.prop(rel.alias, k)) for k in keys])
        e = self._restrict_props(e, rel.alias, rel.props)
        if rel.alias.startswith(" "):
            e = e.drop(self.id(rel.alias))
        self.df = self.df.join(e, F.col(self.id(source)) == F.col("\x1ffrom")).drop("\x1ffrom")
        self._join_target(node, again, self._known(rel))

    def _CountTail(self, tail: list[Step]) -> None:  # noqa: N802
        counts: DataFrame | None = None
        for step in reversed(tail):
            rel, node = step.detail["rel"], step.detail["node"]
            keys = sorted(self.plan.needs[rel.alias])
            e = self._directed(rel, keys)
            e = e.select("\x1ffrom", "\x1fto", *[F.col(f"`{column(k)}`").alias(self.prop(rel.alias, k)) for k in keys])
            e = self._restrict_props(e, rel.alias, rel.props).select("\x1ffrom", "\x1fto")
            if not self.view.closed or not set(node.labels) <= self._known(rel) or node.props:
                ids = self._restrict_props(self._scan(node), node.alias, node.props).select(F.col(self.id(node.alias)).alias("\x1fto"))
                e = e.join(ids, "\x1fto")
            if counts is None:
                counts = e.groupBy("\x1ffrom").agg(F.count(F.lit(1)).alias("\x1fw"))
            else:
                counts = e.join(counts.withColumnRenamed("\x1ffrom", "\x1fto"), "\x1fto").groupBy("\x1ffrom").agg(F.sum("\x1fw").alias("\x1fw"))
        source = tail[0].detail["source"]
        self.df = self.df.join(counts, F.col(self.id(source)) == F.col("\x1ffrom")).drop("\x1ffrom")
        self.weight = F.col("\x1fw")

    def _known(self, rel: RelPattern) -> set[str]:
        src, dst = (self.view.end_labels(rel.types or None, x) for x in ("src", "dst"))
        return {"out": dst, "in": src}.get(rel.direction, src & dst)

    def _VarLengthExpand(self, source: str, rel: RelPattern, node: NodePattern, again: bool) -> None:  # noqa: N802
        found = reach(*self._walk(source, rel)).select(F.col("start").alias("\x1ffrom"), F.col("node").alias("\x1fto"))
        self.df = self.df.join(found, F.col(self.id(source)) == F.col("\x1ffrom")).drop("\x1ffrom")
        self._join_target(node, again, self._known(rel))

    def _walk(self, source: str, rel: RelPattern) -> tuple:
        """What ``reach`` takes: the distinct starts, the edges in the walk's direction, its bounds."""
        e = self._directed(rel, []).select(F.col("\x1ffrom").alias("src"), F.col("\x1fto").alias("dst"))
        starts = self.df.select(F.col(self.id(source)).alias("start")).distinct()
        return starts, e, *rel.hops, self.plan.max_hops, rel.direction not in ("in", "out")

    def _CountWalk(self, source: str, rel: RelPattern, node: NodePattern) -> None:  # noqa: N802
        a, ends, by = node.alias, None, ()
        if a in self.plan.wants_labels:
            by = (self.labels(a),)
        if by or not self.view.closed or not set(node.labels) <= self._known(rel) or node.props:
            ends = self._restrict_props(self._scan(node), a, node.props).select(F.col(self.id(a)).alias("node"), *by)
        counts = reach_counts(*self._walk(source, rel), ends, by).withColumnsRenamed({"start": "\x1ffrom", "n": "\x1fw"})
        self.df = self.df.join(counts, F.col(self.id(source)) == F.col("\x1ffrom")).drop("\x1ffrom")
        self.weight = F.col("\x1fw")

    # -- expressions
    def eval(self, e: Any, known: Mapping[Any, sc.Typed] | None = None, bound: bool = True) -> sc.Typed:
        """Column and type of an expression. ``known`` gives those of whole expressions; with ``bound``
        off nothing but them can be named."""
        p = self.plan
        if known is not None and e in known:
            return known[e]
        go = lambda x: self.eval(x, known, bound)
        if isinstance(e, Lit):
            return sc.literal(e.value)
        if isinstance(e, ListLit):
            return sc.array([go(x) for x in e.items])
        if isinstance(e, Param):
            if e.name not in p.params:
                raise EvalError(f"parameter ${e.name} is not given")
            return sc.literal(p.params[e.name])
        if isinstance(e, Var):
            if not bound or e.name not in p.kinds or e.name.startswith(" "):
                raise EvalError(f"{e.name} is not bound")
            return F.col(self.id(e.name)), p.kinds[e.name]
        if isinstance(e, Prop):
            if not bound and isinstance(e.base, Var):
                raise EvalError(f"{e.base.name}.{e.key} is neither grouped by nor aggregated")
            if isinstance(e.base, Var) and e.base.name in p.kinds:
                t = p.view.catalog.keys(p.kinds[e.base.name]).get(e.key)
                return (F.col(self.prop(e.base.name, e.key)), t) if t else (F.lit(None), "null")
            if go(e.base)[1] == "null":
                return F.lit(None), "null"
            raise EvalError(f"a property of what is neither a node nor an edge: {e.key}")
        if isinstance(e, IsNull):
            c, t = go(e.x)
            return (F.lit(not e.negated) if t == "null" else c.isNotNull() if e.negated else c.isNull()), "bool"
        if isinstance(e, Unary):
            return sc.negate(go(e.x), p.strict) if e.op == "NOT" else sc.minus(go(e.x), p.strict)
        if isinstance(e, Binary):
            a, b = go(e.a), go(e.b)
            if e.op in ("AND", "OR"):
                return sc.logic(e.op, a, b, p.strict)
            if e.op == "IN":
                return sc.contains(a, b)
            if e.op in ("=", "<>", "<", "<=", ">", ">="):
                return sc.compare(e.op, a, b, p.strict)
            return sc.arithmetic(e.op, a, b, p.strict)
        if isinstance(e, Call):
            if e.name in AGGREGATES:
                raise EvalError(f"{e.name} is not allowed here")
            if e.name == "LABELS":
                if isinstance(e.args[0], Var) and p.kinds.get(e.args[0].name) == "node" and bound:
                    return F.col(self.labels(e.args[0].name)), "list:string"
                raise EvalError("labels takes a node")
            if e.name == "COALESCE":
                return sc.coalesce([go(x) for x in e.args])
            return sc.size(go(e.args[0]))
        raise EvalError(f"can't evaluate {e}")

    # -- RETURN
    def result(self) -> DataFrame:
        s = self.plan.stmt
        items: dict[str, Any] = {}
        for i, it in enumerate(s.returns or []):
            items[column_name(it, i)] = it.expr  # of equal names the last counts
        df, known, bound = self.df, {}, True
        if any(has_aggregate(e) for e in items.values()) or any(has_aggregate(e) for e, _ in s.order):
            df, known = self._grouped(items, [e for e, _ in s.order])
            bound = False
        value = lambda e: self.eval(e, known, bound)
        by_name = {k: e for k, e in items.items()}
        out = [_typed(value(e)).alias(k) for k, e in items.items()]
        if s.distinct:
            # sort keys are read off the result's columns
            df = df.select(*out).distinct()
            known, bound = {e: (F.col(f"`{k}`"), value(e)[1]) for k, e in items.items()}, False
            sorts = [self.eval(by_name.get(e.name, e) if isinstance(e, Var) else e, known, bound)[0] for e, _ in s.order]
            out = [F.col(f"`{k}`") for k in items]
        else:
            sorts = [value(by_name.get(e.name, e) if isinstance(e, Var) else e)[0] for e, _ in s.order]
        if sorts:
            hidden = [c.alias(f"\x1fsort{i}") for i, c in enumerate(sorts)]
            df = df.select(*out, *hidden).orderBy(*[F.col(f"\x1fsort{i}").desc() if down else F.col(f"\x1fsort{i}").asc() for i, (_, down) in enumerate(s.order)])
            df = self._limited(df, s)
            return df.drop(*[f"\x1fsort{i}" for i in range(len(sorts))])
        return self._limited(df.select(*out), s)

    @staticmethod
    def _limited(df: DataFrame, s: Statement) -> DataFrame:
        if s.skip:
            df = df.offset(s.skip)
        return df if s.limit is None else df.limit(s.limit)

    def _grouped(self, items: Mapping[str, Any], order: list[Any]) -> tuple[DataFrame, dict[Any, sc.Typed]]:
        keys = [e for e in items.values() if not has_aggregate(e)]
        calls = list(dict.fromkeys(x for e in (*items.values(), *order) for x in walk(e) if isinstance(x, Call) and x.name in AGGREGATES))
        known: dict[Any, sc.Typed] = {}
        cols: list[Column] = []
        for i, e in enumerate(dict.fromkeys(keys)):
            c, t = self.eval(e)
            cols.append(_typed((c, t)).alias(f"\x1fk{i}"))
            known[e] = F.col(f"\x1fk{i}"), t
        aggs: list[Column] = []
        for i, x in enumerate(calls):
            if any(has_aggregate(a) for a in x.args):
                raise PlanError("an aggregate of an aggregate")
            c, t = sc.aggregate(x.name, x.star, None if x.star else self.eval(x.args[0]), getattr(self, "weight", None))
            aggs.append(c.alias(f"\x1fa{i}"))
            known[x] = F.col(f"\x1fa{i}"), t
        return self.df.groupBy(*cols).agg(*aggs) if aggs else self.df.select(*cols).distinct(), known


def _typed(x: sc.Typed) -> Column:
    return x[0].cast("string") if x[1] == "null" else x[0]
