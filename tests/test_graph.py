"""Writes, transactions, constraints, the log and what is rebuilt from it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom import api
from graphloom.catalog import Catalog, box
from graphloom.errors import ConstraintViolation, DataError, GraphClosed, NotFound, RemoteError, SchemaError
from graphloom.graph import Graph
from graphloom.operators.generate import HybridClock, Stamp, rmat, uuid7
from graphloom.operators.index import PropertyIndex
from graphloom.session import scratch
from graphloom.streaming.sync import SyncState, seed, shippable, sync_once


def table(df):  # noqa: ANN001, ANN201
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_catalog() -> None:
    c = Catalog()
    assert c.declare("node", "a", "int") and not c.declare("node", "a", "int")
    with pytest.raises(SchemaError):
        c.declare("node", "a", "string")
    assert box(3, "double") == 3.0 and box(None, "int") is None
    for v, t in ((1.5, "int"), ("x", "int"), (True, "int"), ([1], "string")):
        with pytest.raises(SchemaError):
            box(v, t)
    assert c.intern_label("L") == c.intern_label("L") == 0 and c.label_name(0) == "L" and c.label_id("M") is None


def test_life_of_a_graph(spark) -> None:  # noqa: ANN001
    g = Graph.empty(spark)

    def body(t):  # noqa: ANN001, ANN202
        a, b = t.add_node(["P"], {"name": "a", "n": 1}, "id-a"), t.add_node(["P", "Q"], {"name": "b", "n": None})
        t.add_edge(a, b, "e", {"w": 2})
        t.add_edge(b, b, "e")
        return a, b

    a, b = g.transact(body)
    assert [r.vid for r in api.by_logical_id(g.view, "id-a").collect()] == [a]
    assert [r.vid for r in api.find_nodes(g.view, "n", None).collect()] == [b]  # explicit null
    assert api.find_nodes(g.view, "n", 1.0).count() == 0 and api.find_node(g.view, "name", "b", "Q").count() == 1
    assert {tuple(r) for r in api.degrees(g.view).collect()} == {(a, 1, 0), (b, 1, 2)}
    assert api.counts(g.view).first().asDict() == {"nodes": 2, "edges": 2, "id_space": 2}
    pinned = g.pin()
    g.execute("MATCH (p:P) WHERE p.n = 1 SET p.n = p.n + 1, p.name = null")
    assert [tuple(r) for r in g.execute("MATCH (p:P) RETURN p.n AS n, p.name AS m ORDER BY n").collect()] == [(None, "b"), (2, None)]
    assert pinned.nodes((), ("n",)).agg(F.max("p_n")).first()[0] == 1
    g.transact(lambda t: (t.set_edge_prop(0, "w", 5), t.set_node_labels(b, ["R"], ["Q"]), t.del_node_prop(b, "n")), capture_prev=True)
    again = Graph.open(spark, g.path)
    assert table(again.version.nodes) == table(g.version.nodes) and table(again.version.edges) == table(g.version.edges)
    g.checkpoint()
    g.execute("MATCH (p:R) DELETE p")
    assert g.execute("MATCH (x)-->(y) RETURN x").count() == 0
    again = Graph.open(spark, g.path)
    assert table(again.version.nodes) == table(g.version.nodes) and again.next_vid == g.next_vid and again.current_lsn == g.current_lsn
    g.close()
    with pytest.raises(GraphClosed):
        g.execute("CREATE (x:P)")


def test_batches_are_all_or_nothing(spark) -> None:  # noqa: ANN001
    g = Graph.empty(spark)
    a = g.transact(lambda t: t.add_node(["P"], {"k": 1}))
    before, lsn = table(g.version.nodes), g.current_lsn

    def failing(t):  # noqa: ANN001, ANN202
        t.add_node(["P"], {"k": 2})
        raise ValueError

    with pytest.raises(ValueError):
        g.transact(failing)
    for body, error in (
        (lambda t: (t.add_node(["P"]), t.add_edge(a, 99, "e")), NotFound),
        (lambda t: t.set_node_prop(a, "k", "text"), SchemaError),
        (lambda t: t.add_node([]), DataError),
        (lambda t: t.set_node_labels(a, ["X"], ["X"]), DataError),
        (lambda t: t.set_node_labels(a, [], ["P"]), DataError),
        (lambda t: (t.del_node(a), t.set_node_prop(a, "k", 3)), NotFound),
    ):
        with pytest.raises(error):
            g.transact(body)
    g.add_constraint("unique", "P", "k")
    g.add_constraint("exists", "P", "k")
    for body in (lambda t: t.add_node(["P"], {"k": 1}), lambda t: t.add_node(["P"]), lambda t: t.del_node_prop(a, "k")):
        with pytest.raises(ConstraintViolation):
            g.transact(body)
    with pytest.raises(ConstraintViolation):
        g.execute("MATCH (p:P) SET p.other = 1, p.k = 7 RETURN p") and g.execute("CREATE (p:P {k: 7})")
    assert g.current_lsn > lsn and before


def test_merge_and_bulk(spark) -> None:  # noqa: ANN001
    g = Graph.empty(spark)
    for _ in range(2):
        g.execute("MERGE (c:City {name: 'Oslo'})")
    assert g.execute("MATCH (c:City) RETURN c").count() == 1
    ids = spark.createDataFrame([(0, 0), (0, 0)], "src long, dst long")
    assert g.bulk_add_edges(ids, "loop") == 2
    with pytest.raises(NotFound):
        g.bulk_add_edges(spark.createDataFrame([(0, 9)], "src long, dst long"), "loop")
    assert g.execute("MATCH (a)-[:loop]->(b) RETURN COUNT(*) AS n").first().n == 2
    again = Graph.open(spark, g.path)
    assert again.execute("MATCH (a)-[:loop]->(b) RETURN COUNT(*) AS n").first().n == 2


def test_index(spark) -> None:  # noqa: ANN001
    g = Graph.empty(spark)
    g.transact(lambda t: [t.add_node(["P"], {"k": k}) for k in (3, 1, None, 3, 7)])
    i = PropertyIndex.build(g.view, "k", scratch(spark, "i") + "/t")
    assert i.bounds(3).first().asDict() == {"lower": 1, "upper": 3, "length": 4}
    assert i.equal(3).count() == 2 and i.between(1, 7).count() == 3
    g.create_index("x", "node", "k")
    with pytest.raises(DataError):
        g.create_index("x", "node", "k")
    with pytest.raises(SchemaError):
        g.create_index("y", "node", "nosuch")
    g.drop_index("x")


def test_sync_stops_at_a_refusal_and_goes_on_later(spark) -> None:  # noqa: ANN001
    rows = spark.createDataFrame([(i,) for i in range(1, 11)], "lsn long")
    state, sent, aside, refuse = SyncState(spark, scratch(spark, "s") + "/state.json"), [], [], {6}

    def send(df) -> None:  # noqa: ANN001
        got = [r.lsn for r in df.orderBy("lsn").collect()]
        if refuse & set(got):
            raise RemoteError("no")
        sent.extend(got)

    go = lambda: sync_once(lambda m: rows.filter(F.col("lsn") > m), state, "t", send, lambda d, why, at: aside.append((d.count(), why)), 4)
    assert go() == 1 and sent == [1, 2, 3, 4] and aside == [(4, "no")]
    refuse.clear()
    assert go() == 2 and sent == list(range(1, 11)) and go() == 0
    assert seed(lambda: (rows, rows), state, "u", lambda d: None, 7) and not seed(lambda: (rows, rows), state, "u", lambda d: None, 7)


def test_shippable(spark) -> None:  # noqa: ANN001
    log = spark.createDataFrame([(1, 1, "AddNode", 5, None, "n5", [2, 1], None, None, None, None), (2, 1, "AddNode", 6, None, "n6", [], None, None, None, None), (3, 1, "AddEdge", None, 1, "e1", None, 5, 6, 0, None), (3, 1, "AddEdge", None, 1, "e1", None, 5, 6, 0, None), (4, 1, "CommitTxn", None, None, None, None, None, None, None, 4), (5, 2, "AddNode", 7, None, "n7", [1], None, None, None, None)], "lsn long, txn_id long, op string, vid long, eid long, logical_id string, label_ids array<int>, src long, dst long, type_id int, commit_lsn long")
    names = spark.createDataFrame([("label", 1, "A"), ("label", 2, "B"), ("edgeType", 0, "knows")], "name_kind string, int_id int, interned string")
    got = [(r.lsn, r.labels, r.edge_type, r.src, r.dst) for r in shippable(log, names).orderBy("lsn").collect()]
    assert got == [(1, ["A", "B"], None, None, None), (2, ["unlabeled_node"], None, None, None), (3, None, "knows", "n5", "n6")]
    assert shippable(log, names, 2).count() == 1
    with pytest.raises(Exception, match="no label"):
        shippable(log, names, 0, None).collect()


def test_generators(spark) -> None:  # noqa: ANN001
    e = rmat(spark, 8, 2000)
    assert e.agg(F.max("src"), F.min("dst")).first()[0] < 256 and table(e) == table(rmat(spark, 8, 2000).repartition(3))
    assert uuid7(5) < uuid7(6) and uuid7()[14] == "7"
    c = HybridClock("x", lambda: 10)
    a, b = c.tick(), c.tick(Stamp(12, 4, "y"))
    assert a < b == Stamp(12, 5, "x") and c.tick() == Stamp(12, 6, "x")


def test_import(spark) -> None:  # noqa: ANN001
    g = Graph.empty(spark)
    g.transact(lambda t: t.add_node(["City"], {"name": "Oslo"}, "oslo"))
    nodes = spark.createDataFrame([("a", ["P", "Q", "P"], "Ann", 3), ("b", ["P"], None, 4)], "logical_id string, labels array<string>, p_name string, p_n long")
    edges = spark.createDataFrame([("a", "b", "knows", 1.5), ("b", "oslo", "livesIn", None), ("a", "b", "knows", 2.5)], "src string, dst string, type string, p_w double")
    assert g.bulk_import(nodes, edges) == (2, 3)
    assert sorted(tuple(r) for r in g.execute("MATCH (x:P)-[r]->(y) RETURN x.n AS n, y.name AS m, r.w AS w").collect() if r.w) == [(3, None, 1.5), (3, None, 2.5)]
    assert g.execute("MATCH (x:Q) RETURN labels(x) AS l, x.name AS m").first().asDict() == {"l": ["P", "Q"], "m": "Ann"}
    again = Graph.open(spark, g.path)
    assert table(again.version.nodes) == table(g.version.nodes) and table(again.version.edges) == table(g.version.edges)
    before = table(g.version.nodes)
    for bad_nodes, bad_edges, error in (
        (nodes, None, ConstraintViolation),
        (nodes.limit(1).selectExpr("'z' as logical_id", "array() as labels"), None, DataError),
        (nodes.limit(0), edges.selectExpr("src", "'nowhere' as dst", "type"), NotFound),
        (nodes.limit(1).selectExpr("'y' as logical_id", "labels", "p_n as p_name"), None, SchemaError),
    ):
        with pytest.raises(error):
            g.bulk_import(bad_nodes, bad_edges)
    assert table(g.version.nodes) == before


def test_schema_and_single_edges(spark) -> None:  # noqa: ANN001
    from graphloom.schema import GraphSchema

    g = Graph.empty(spark)
    s = GraphSchema(g, ["P", "C"], ["worksAt"], {"name": "string", "score": "double"})
    a, b, c = s.add("P", {"name": "Ann", "score": 2}), s.add("C", {"name": "Co"}), s.add("C", {"name": "Do"})
    for bad in (lambda: s.add("X"), lambda: s.add("P", {"nope": 1}), lambda: s.add("P", {"score": "x"}), lambda: s.connect(a, b, "x"), lambda: GraphSchema(g, [], [], {"name": "int"})):
        with pytest.raises(SchemaError):
            bad()
    assert s.find("P", "score", 2) == a and s.find("C", "name", "Ann") is None and s.find_all("C", "name", "Co").count() == 1
    s.connect(a, b, "worksAt")
    assert g.add_edge_if_absent(a, b, "worksAt") is None and g.add_edge_if_absent(b, c, "worksAt") is not None
    g.replace_edge(a, c, "worksAt")
    assert [r.neighbour for r in s.neighbours(a, "worksAt").collect()] == [c]
    assert {r.neighbour for r in s.neighbours(c, "worksAt", "in").collect()} == {a, b}
