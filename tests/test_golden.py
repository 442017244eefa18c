"""Results known beforehand on small fixed graphs, and operations that have no SQL."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.catalog import Catalog
from graphloom.errors import DataError, SchemaError
from graphloom.graph import Graph
from graphloom.operators.generate import quadrants, rmat
from graphloom.sources import graphjson
from graphloom.streaming.sync import _heads, id_map

PEOPLE = (("Alice", 30, "NYC"), ("Bob", 25, "NYC"), ("Charlie", 40, "SF"), ("Dave", 28, "NYC"), ("Eve", 22, "SF"))


def made(spark, nodes, edges) -> Graph:  # noqa: ANN001
    g = Graph.empty(spark)

    def body(t):  # noqa: ANN001, ANN202
        ids = [t.add_node([label], props) for label, props in nodes]
        for a, b, kind in edges:
            t.add_edge(ids[a], ids[b], kind)

    g.transact(body)
    g.merge_now()
    return g


@pytest.fixture(scope="module")
def people(spark) -> Graph:  # noqa: ANN001
    return made(spark, [("Person", {"name": n, "age": a, "city": c}) for n, a, c in PEOPLE], [(a, b, "knows") for a, b in ((0, 1), (0, 2), (1, 2), (2, 3), (3, 4))])


@pytest.fixture(scope="module")
def chain(spark) -> Graph:  # noqa: ANN001
    return made(spark, [("Person", {"name": n}) for n in "ABCDE"], [(i, i + 1, "knows") for i in range(4)])


@pytest.fixture(scope="module")
def social(spark) -> Graph:  # noqa: ANN001
    nodes = [("Person", {"name": "alice", "age": 30, "city": "NYC"}), ("Person", {"name": "bob", "age": 25, "city": "SF"}), ("Person", {"name": "charlie", "age": 40, "city": "NYC"})]
    nodes += [("Post", {"title": "p1", "text": "hello"}), ("Post", {"title": "p2", "text": "world"}), *[("Comment", {"text": f"c{i}"}) for i in (1, 2, 3)]]
    edges = [(0, 1, "KNOWS"), (1, 2, "KNOWS"), (0, 3, "CREATED"), (1, 4, "CREATED"), (1, 5, "CREATED"), (0, 6, "CREATED"), (2, 7, "CREATED"), (5, 3, "REPLY_OF"), (6, 4, "REPLY_OF"), (7, 5, "REPLY_OF")]
    return made(spark, nodes, edges)


def one(g: Graph, q: str) -> list:
    return [r[0] if len(r) == 1 else tuple(r) for r in g.execute(q).collect()]


@pytest.mark.parametrize(
    ("q", "want"),
    [
        ("MATCH (n:Person) WHERE n.age > 28 RETURN n.name", ["Alice", "Charlie"]),
        ("MATCH (n:Person) WHERE n.age > 25 AND n.age < 40 RETURN n.name", ["Alice", "Dave"]),
        ("MATCH (a:Person {name: 'Alice'})-[:knows]->(b) RETURN b.name", ["Bob", "Charlie"]),
        ("MATCH (a:Person {name: 'Charlie'})<-[:knows]-(b) RETURN b.name", ["Alice", "Bob"]),
        ("MATCH (a:Person {name: 'Alice'})-[:knows]->()-[:knows]->(c) RETURN c.name", ["Charlie", "Dave"]),
        ("MATCH (n:Person) RETURN SUM(n.age), AVG(n.age), MIN(n.age), MAX(n.age)", [(145, 29.0, 22, 40)]),
        ("MATCH (n:Person) RETURN n.city, COUNT(*)", [("NYC", 3), ("SF", 2)]),
        ("MATCH (n:Person) WHERE size(n.name) = 3 RETURN n.name", ["Bob", "Eve"]),
        ("MATCH (n:Person) WHERE length(n.name) > 4 RETURN n.name", ["Alice", "Charlie"]),
        ("MATCH (n:Person) RETURN coalesce(n.nickname, n.name)", ["Alice", "Bob", "Charlie", "Dave", "Eve"]),
    ],
)
def test_people(people: Graph, q: str, want: list) -> None:
    assert sorted(one(people, q)) == want


def test_order_of_people(people: Graph) -> None:
    assert one(people, "MATCH (n:Person) RETURN n.name ORDER BY n.city, n.age DESC") == ["Alice", "Dave", "Bob", "Charlie", "Eve"]
    assert one(people, "MATCH (n:Person) RETURN n.name ORDER BY n.name SKIP 1 LIMIT 2") == ["Bob", "Charlie"]


@pytest.mark.parametrize(("walk", "want"), [("(a:Person {name: 'A'})-[:knows*1..2]->(b)", "BC"), ("(a:Person {name: 'A'})-[:knows*1..4]->(b)", "BCDE"), ("(a:Person {name: 'A'})-[:knows*2..2]->(b)", "C"), ("(a:Person {name: 'A'})-[:knows*]->(b)", "BCDE"), ("(a:Person {name: 'D'})<-[:knows*1..2]-(b)", "BC")])
def test_walks_on_a_chain(chain: Graph, walk: str, want: str) -> None:
    assert "".join(sorted(one(chain, f"MATCH {walk} RETURN b.name"))) == want


def test_acceptance(social: Graph) -> None:
    assert sorted(one(social, "MATCH (a:Person {name: 'alice'})-[:KNOWS*1..2]->(b) RETURN b.name")) == ["bob", "charlie"]
    assert one(social, "MATCH (p:Person {city: 'NYC'})-[:CREATED]->(x:Post) RETURN x.title") == ["p1"]
    assert sorted(one(social, "MATCH (p:Person)-[:CREATED]->(c:Comment) RETURN p.name, COUNT(*)")) == [("alice", 1), ("bob", 1), ("charlie", 1)]
    n, mean, lo, hi = one(social, "MATCH (p:Person) RETURN COUNT(*), AVG(p.age), MIN(p.age), MAX(p.age)")[0]
    assert (n, lo, hi) == (3, 25, 40) and abs(mean - 31.667) < 1e-3
    assert {c: sorted(x) for c, x in one(social, "MATCH (p:Person) RETURN p.city, COLLECT(p.name)")} == {"NYC": ["alice", "charlie"], "SF": ["bob"]}
    assert one(social, "MATCH (p:Person) RETURN p.name ORDER BY p.age DESC LIMIT 2") == ["charlie", "alice"]
    assert sorted(one(social, "MATCH (c:Comment)-[:REPLY_OF*1..3]->(p:Post {title: 'p1'}) RETURN c.text")) == ["c1", "c3"]


def test_counts_without_paths_equal_counted_paths(spark) -> None:  # noqa: ANN001
    """Aggregates over a tail that nothing names, on parallel edges, loops, properties and labels."""
    import random

    r = random.Random(5)
    g = Graph.empty(spark)

    def body(t):  # noqa: ANN001, ANN202
        ids = [t.add_node([r.choice("AB")], {"k": r.randrange(4), **({"w": r.randrange(9)} if r.random() < 0.7 else {})}) for _ in range(12)]
        for _ in range(40):
            t.add_edge(r.choice(ids), r.choice(ids), r.choice("xy"), {"p": r.randrange(3)})

    g.transact(body)
    g.merge_now()
    tails = ["-->()", "-[:x]->(b:A)", "<-[:y]-(b)-->(c:B {k: 1})", "-[:x {p: 1}]->(b)<--(c)-[:y]-(d:A)", "-[:x]-(b)"]
    for tail in tails:
        # the same with every name returned: counted one by one
        text = tail
        for i, plain in enumerate(("()", "(b", "(c", "(d")):
            text = text.replace("()", f"(z{i})", 1) if plain == "()" else text
        names = [n for n in ("z0", "b", "c", "d") if f"({n}" in text]
        paths = g.execute(f"MATCH (a){text} RETURN a.k AS k, a.w AS w, {', '.join(names)}").collect()
        want = {k: (len(x), sum(p.w or 0 for p in x), sum(p.w is not None for p in x), max((p.w for p in x if p.w is not None), default=None)) for k in {p.k for p in paths} for x in [[p for p in paths if p.k == k]]}
        from graphloom.plans.query import explain

        q = f"MATCH (a){tail} RETURN a.k AS k, COUNT(*) AS n, SUM(a.w) AS s, COUNT(a.w) AS m, MAX(a.w) AS hi, AVG(a.w) AS mean"
        assert "CountTail" in explain(g.view, q)
        got = g.execute(q).collect()
        assert {x.k: (x.n, x.s, x.m, x.hi) for x in got} == want, tail
        assert all(x.mean is None if not x.m else abs(x.mean - x.s / x.m) < 1e-9 for x in got)
    assert g.execute("MATCH (a)-[:x]->(b) WHERE a.k > 99 RETURN COUNT(*) AS n, SUM(a.w) AS s, AVG(a.w) AS m").first().asDict() == {"n": 0, "s": 0, "m": None}


def test_reads(people: Graph, spark) -> None:  # noqa: ANN001
    v, ids = people.view, spark.createDataFrame([(0,), (4,), (77,)], "vid long")
    assert {tuple(r) for r in api.visible(v, ids).collect()} == {(0, True), (4, True), (77, False)}
    assert {tuple(r) for r in api.has_label(v, ids, "Person").collect()} == {(0, True), (4, True), (77, False)} and api.has_label(v, ids, "X").filter("has").count() == 0
    assert {r.vid for r in api.logical_ids(v, ids).collect()} == {0, 4}
    assert api.typed_values(v, "age", "int").count() == 5 and api.property_type(v, "node", "name") == "string" and api.property_type(v, "edge", "name") is None
    for t in ("double", "string"):
        with pytest.raises(SchemaError):
            api.typed_values(v, "age", t)
    assert api.topology(v).first().asDict() == {"nodes": 5, "edges": 5, "id_space": 5, "tombstones": 0, "dangling": 0}
    nodes, edges = spark.createDataFrame([(0, ["A"])], "vid long, labels array<string>"), spark.createDataFrame([(0, 0, 9, "T"), (1, 0, 0, "T")], "eid long, src long, dst long, type string")
    g = Graph.of(spark, nodes, edges, Catalog({}, {}, ["A"], ["T"]), dangling="keep")
    assert api.topology(g.view).first().dangling == 1 and [r.neighbour for r in api.neighbours(g.view, nodes).collect()] == [0]


def test_json_document(spark) -> None:  # noqa: ANN001
    g = Graph.empty(spark)
    doc = {"v": 1, "labels": ["P", "Q"], "edgeTypes": ["knows"], "propKeys": ["name", "n", "w"], "nodes": [{"id": 7, "l": [0], "p": {"0": "a", "1": 1}}, {"id": 9, "l": [0, 1], "p": {"1": None}}], "edges": [{"s": 7, "d": 9, "t": 0, "p": {"2": 1.5}}]}
    assert graphjson.load(g, json.dumps(doc)) == {7: 0, 9: 1}
    again = Graph.empty(spark)
    graphjson.load(again, graphjson.dump(g))
    assert json.loads(graphjson.dump(again)) == json.loads(graphjson.dump(g))
    for bad in ({**doc, "v": 2}, {**doc, "edges": [{"s": 7, "d": 5, "t": 0}]}):
        with pytest.raises(DataError):
            graphjson.load(Graph.empty(spark), json.dumps(bad))


def test_id_map_keeps_the_last_pair_of_both_sides(spark) -> None:  # noqa: ANN001
    import random

    r = random.Random(3)
    pairs = [(f"l{r.randrange(6)}", f"r{r.randrange(6)}", t) for t in range(40)] + [(None, "r1", 99), ("l1", None, 99)]
    by_logical: dict = {}
    for a, b, _ in pairs:
        if a and b:
            by_logical = {x: y for x, y in by_logical.items() if x != a and y != b} | {a: b}
    got = id_map(spark.createDataFrame(pairs, "logical_id string, remote_id string, t long"), "t")
    assert {tuple(x) for x in got.collect()} == set(by_logical.items())


def test_batches_end_in_one_pass(spark) -> None:  # noqa: ANN001
    lsns = sorted([1, 1, 1, 2, 3, 3, 5, 8, 8, 8, 9])
    df = spark.createDataFrame([(x,) for x in lsns], "lsn long").coalesce(1).sortWithinPartitions("lsn")
    assert list(_heads(df, 3)) == [1, 3, 8, 9] and list(_heads(df.limit(0), 3)) == []


def test_rmat_follows_its_quadrants(spark) -> None:  # noqa: ANN001
    e = rmat(spark, 10, 20_000, a=0.57, b=0.19, c=0.19)
    want = Counter()
    for x in e.collect():
        for k in range(10):
            want[k, "abcd"[(x.src >> k) % 2 * 2 + (x.dst >> k) % 2]] += 1
    got = {(x.bit, x.quadrant): x.n for x in quadrants(e, 10).collect()}
    assert got == want
    for q, share in zip("abcd", (0.57, 0.19, 0.19, 0.05), strict=True):
        assert all(abs(got[k, q] / 20_000 - share) < 0.02 for k in range(10)), q
    assert e.agg(F.max("src")).first()[0] < 1 << 10
