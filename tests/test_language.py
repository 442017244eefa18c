"""The query language: tokens, syntax errors, and what queries mean on a small graph."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.errors import EvalError, LexError, ParseError, PlanError
from graphloom.graph import Graph
from graphloom.plans.query import PlanCache, explain, run
from graphloom.plans.syntax import Binary, Lit, Prop, Unary, Var, parse, tokenize


@pytest.fixture(scope="module")
def g(spark):  # noqa: ANN001, ANN201
    g = Graph.empty(spark)

    def body(t):  # noqa: ANN001, ANN202
        v = {}
        for name, age, city in (("Ann", 30, "Oslo"), ("Bob", 25, "Oslo"), ("Cid", 41, None), ("Dot", None, "Rome"), ("Eve", 25, "Rome")):
            v[name] = t.add_node(["Person", "Admin"] if name == "Ann" else ["Person"], {"name": name, **({"age": age} if age else {}), **({"city": city} if city else {})})
        v["Post"] = t.add_node(["Post"], {"title": "t1", "score": 1.5})
        for a, b, since in (("Ann", "Bob", 1), ("Bob", "Cid", 2), ("Cid", "Ann", 3), ("Cid", "Dot", 4), ("Dot", "Eve", 5), ("Eve", "Eve", 6)):
            t.add_edge(v[a], v[b], "knows", {"since": since})
        t.add_edge(v["Ann"], v["Bob"], "knows", {"since": 9})
        t.add_edge(v["Ann"], v["Post"], "wrote")
        return v

    g.ids = g.transact(body)
    g.merge_now()
    return g


def rows(g, q, **params):  # noqa: ANN001, ANN003, ANN201
    return [tuple(r) for r in g.execute(q, params).collect()]


def test_tokens() -> None:
    assert [t.kind for t in tokenize("match (a) // note\n return 'x\\n' 1 2.5 $p <- ..")] == ["keyword", "symbol", "word", "symbol", "keyword", "string", "int", "float", "param", "symbol", "symbol", "end"]
    for bad in ("'open", "'a\nb'", "'\\q'", "#"):
        with pytest.raises(LexError):
            tokenize(bad)


def test_precedence() -> None:
    e = parse("MATCH (a) WHERE NOT a.x = 1 + 2 * -3 OR true AND false RETURN a").where
    assert e == Binary("OR", Unary("NOT", Binary("=", Prop(Var("a"), "x"), Binary("+", Lit(1), Binary("*", Lit(2), Unary("-", Lit(3)))))), Binary("AND", Lit(True), Lit(False)))


@pytest.mark.parametrize("q", ["MATCH (a)", "MATCH (a) RETURN", "RETURN 1", "MATCH (a) RETURN a LIMIT x", "MATCH (a) RETURN a LIMIT 1 LIMIT 2", "MATCH (a)<-[:x]->(b) RETURN a", "MATCH (a) RETURN foo(a)", "MATCH (a) RETURN size(a, a)", "MERGE (a:X)-[:y]->(b)", "MATCH (a)-[:x*3..1]->(b) RETURN a", "MATCH (a) RETURN a extra"])
def test_syntax_errors(q: str) -> None:
    with pytest.raises(ParseError):
        parse(q)


def test_error_names_the_place() -> None:
    with pytest.raises(ParseError) as e:
        parse("MATCH (a)\nRETURN foo(a)")
    assert (e.value.line, e.value.column, e.value.token) == (2, 8, "foo")
    assert "RETURN foo(a)\n       ^" in str(e.value)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="MATCH(ab):-[]><*.,12'\" RETURN=+$", max_size=40))
def test_any_text_parses_or_raises_a_query_error(s: str) -> None:
    try:
        parse(s)
    except (LexError, ParseError):
        pass


def test_expand_and_names(g) -> None:  # noqa: ANN001
    assert sorted(rows(g, "MATCH (a:Person)-[:knows]->(b) WHERE a.name = 'Ann' RETURN a.name, b.name AS x")) == [("Ann", "Bob"), ("Ann", "Bob")]
    assert g.execute("MATCH (a:Person) RETURN a.name, a.name AS x, COUNT(*), size(a.name), a.age + 1").columns == ["a.name", "x", "COUNT(*)", "SIZE(a.name)", "col4"]
    # a self-loop is met from both sides
    assert rows(g, "MATCH (a:Person {name: 'Eve'})-[:knows]-(b) RETURN COUNT(*) AS n") == [(3,)]
    assert rows(g, "MATCH (a:Person)-->(b) WHERE a.name = 'Ann' RETURN COUNT(b) AS n") == [(3,)]


def test_null_and_types(g) -> None:  # noqa: ANN001
    assert rows(g, "MATCH (p:Person) WHERE p.nosuch = null RETURN COUNT(*) AS n") == [(5,)]
    assert rows(g, "MATCH (p:Person) WHERE p.age = '25' RETURN p.name AS n") == []
    assert sorted(rows(g, "MATCH (p:Person) WHERE p.age > 26 RETURN p.name AS n")) == [("Ann",), ("Cid",)]
    assert sorted(rows(g, "MATCH (p:Person) WHERE p.city <> 'Oslo' RETURN p.name AS n")) == [("Cid",), ("Dot",), ("Eve",)]
    with pytest.raises(EvalError):
        g.execute("MATCH (p:Person) WHERE p.age > 'x' RETURN p")
    with pytest.raises(EvalError):
        g.execute("MATCH (p:Person) WHERE p.name RETURN p")
    with pytest.raises(Exception, match="of null"):
        g.execute("MATCH (p:Person) WHERE p.age > 26 RETURN p.name AS n", strict=True).collect()


def test_arithmetic(g) -> None:  # noqa: ANN001
    assert rows(g, "MATCH (p:Post) RETURN 7 / 2 AS a, 6 / 2 AS b, (0 - 7) % 3 AS c, 'a' + 'b' AS d, p.score / 0.0 AS e, 2 * 3 + 1 AS f, -p.score AS g") == [(3.5, 3.0, 2, "ab", float("inf"), 7, -1.5)]
    with pytest.raises(Exception, match="(?i)zero"):
        g.execute("MATCH (p:Post) RETURN 1 / 0 AS a").collect()


def test_functions(g) -> None:  # noqa: ANN001
    assert rows(g, "MATCH (p:Admin) RETURN size('a😀') AS a, length(labels(p)) AS b, labels(p) AS c, coalesce(p.nosuch, p.name) AS d, coalesce() AS e") == [(3, 2, ["Admin", "Person"], "Ann", None)]
    assert sorted(rows(g, "MATCH (p) WHERE 'Person' IN labels(p) AND p.name IN ['Ann', 'Eve'] RETURN p.name AS n")) == [("Ann",), ("Eve",)]
    assert sorted(rows(g, "MATCH (p:Person) WHERE p.age IS NULL OR p.city IS NULL RETURN p.name AS n")) == [("Cid",), ("Dot",)]


def test_aggregates(g) -> None:  # noqa: ANN001
    assert rows(g, "MATCH (p:Person) WHERE p.age > 99 RETURN COUNT(*) AS n, SUM(p.age) AS s, AVG(p.age) AS a, MIN(p.age) AS lo, COLLECT(p.age) AS l") == [(0, 0, None, None, [])]
    assert sorted(rows(g, "MATCH (p:Person) RETURN p.city AS c, COUNT(p.age) AS n, SUM(p.age) AS s"), key=str) == sorted([("Oslo", 2, 55), (None, 1, 41), ("Rome", 1, 25)], key=str)
    assert rows(g, "MATCH (p:Person) RETURN p.city AS c, COUNT(*) + 1 AS n ORDER BY COUNT(*) DESC, c LIMIT 2") == [("Oslo", 3), ("Rome", 3)]
    with pytest.raises((PlanError, EvalError)):
        g.execute("MATCH (p:Person) RETURN COUNT(*) AS n ORDER BY p.name")


def test_order_distinct_limit(g) -> None:  # noqa: ANN001
    assert rows(g, "MATCH (p:Person) RETURN p.name AS n ORDER BY p.age, p.name") == [("Dot",), ("Bob",), ("Eve",), ("Ann",), ("Cid",)]
    assert rows(g, "MATCH (p:Person) RETURN p.name AS n ORDER BY n DESC SKIP 1 LIMIT 2") == [("Dot",), ("Cid",)]
    assert rows(g, "MATCH (p:Person) RETURN DISTINCT p.age AS a ORDER BY a DESC LIMIT 2") == [(41,), (30,)]


def test_walks_give_distances(g) -> None:  # noqa: ANN001
    assert sorted(rows(g, "MATCH (a:Person {name: 'Ann'})-[:knows*1..2]->(b) RETURN b.name AS n")) == [("Bob",), ("Cid",)]
    assert sorted(rows(g, "MATCH (a:Person {name: 'Ann'})-[:knows*]->(b) RETURN b.name AS n")) == [("Bob",), ("Cid",), ("Dot",), ("Eve",)]  # never itself
    assert rows(g, "MATCH (a:Person {name: 'Eve'})-[:knows*]->(b) RETURN b.name AS n") == []
    # in a triangle everything is one hop away, nothing two
    assert sorted(rows(g, "MATCH (a:Person {name: 'Ann'})-[:knows*2]-(b) RETURN b.name AS n")) == [("Dot",)]
    assert rows(g, "MATCH (a:Person {name: 'Ann'})-[:knows*3..]->(b) WHERE b.city = 'Rome' RETURN COUNT(*) AS n") == [(2,)]
    with pytest.raises(EvalError, match="hops"):
        run(g.view, "MATCH (a:Person {name: 'Ann'})-[:knows*]->(b) RETURN b", max_hops=2)


def test_edge_names_and_cycles(g) -> None:  # noqa: ANN001
    assert sorted(rows(g, "MATCH (a)-[r:knows]->(b) WHERE r.since > 4 RETURN r.since AS s")) == [(5,), (6,), (9,)]
    assert rows(g, "MATCH (a)-[r:knows {since: 4}]->(b) RETURN a.name AS a, b.name AS b") == [("Cid", "Dot")]
    assert sorted(rows(g, "MATCH (a:Person)-[:knows]->(b)-[:knows]->(c)-[:knows]->(a) RETURN a.name AS a, b.name AS b")) == [("Ann", "Bob"), ("Ann", "Bob"), ("Bob", "Cid"), ("Bob", "Cid"), ("Cid", "Ann"), ("Cid", "Ann"), ("Eve", "Eve")]
    assert sorted(rows(g, "MATCH (a:Admin)-[:knows]->(b), (b)-[:knows]->(c) RETURN c.name AS c")) == [("Cid",), ("Cid",)]


@pytest.mark.parametrize("q", ["MATCH (a:Nope) RETURN a", "MATCH (a)-[:nope]->(b) RETURN a", "MATCH (a)-[a:knows]->(b) RETURN a", "MATCH (a:Person), (b:Post) RETURN a", "MATCH (a)-[r:knows*2]->(b) RETURN a"])
def test_plan_errors(g, q: str) -> None:  # noqa: ANN001
    with pytest.raises(PlanError):
        g.execute(q)


def test_names_and_parameters(g) -> None:  # noqa: ANN001
    with pytest.raises(EvalError):
        g.execute("MATCH (a:Person) RETURN b.name")
    with pytest.raises(EvalError):
        g.execute("MATCH (a:Person) WHERE a.name = $p RETURN a")
    assert rows(g, "MATCH (a:Person) WHERE a.name IN $p RETURN a.age AS x", p=["Bob"]) == [(25,)]
    # aliases that differ in case are different names
    assert rows(g, "MATCH (a:Admin)-[:wrote]->(A:Post) RETURN a.name AS x, A.title AS y") == [("Ann", "t1")]
    said = []
    g.execute("MATCH (a:Person) RETURN a.label AS l", on_diagnostic=said.append)
    assert said and said[0].severity == "warning"


def test_plan_cache_and_explain(g) -> None:  # noqa: ANN001
    c = PlanCache(2)
    for q in ("MATCH (a) RETURN a", "MATCH (b) RETURN b", "MATCH (a) RETURN a", "MATCH (c) RETURN c"):
        c.get(q)
    assert c.hits == 1 and list(c.kept) == ["MATCH (a) RETURN a", "MATCH (c) RETURN c"]
    assert explain(g.view, "MATCH (a:Person)-[:knows]->(b) WHERE a.age > 1 RETURN b").split("(")[0] == "NodeScan"


def test_only_needed_sources_and_columns_are_read(spark, sf) -> None:  # noqa: ANN001
    from graphloom.sources.commerce import commerce

    df = run(commerce(spark, sf), "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.mktsegment = 'BUILDING' RETURN COUNT(*) AS n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "o_totalprice" not in plan  # the order itself is not joined
    assert "EqualNullSafe(c_mktsegment,BUILDING)" in plan
