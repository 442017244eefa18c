"""What is on disk: the log, manifests, and a graph opened after a crash at any moment."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.errors import ConstraintViolation, CorruptionDetected, DataError, NotFound, SchemaError
from graphloom.graph import Graph
from graphloom.journal import Journal, Numbered
from graphloom.model import column
from graphloom.operators.index import PropertyIndex
from graphloom.session import scratch


def rows(g: Graph) -> list:
    return sorted((r.vid, r.labels, r.p_k) for r in g.version.nodes.select("vid", "labels", "p_k").collect())


def small(spark) -> Graph:  # noqa: ANN001
    g = Graph.empty(spark)
    g.transact(lambda t: [t.add_node(["P"], {"k": k}) for k in (1, 2, 3)])
    return g


@pytest.mark.parametrize("step", ["_store", "_point", "_drop_before"])
@pytest.mark.parametrize("when", ["before", "after"])
def test_a_crash_at_any_step_of_a_checkpoint_loses_nothing(spark, monkeypatch, step: str, when: str) -> None:  # noqa: ANN001
    g = small(spark)
    if when == "after":
        g.checkpoint()  # there may be a manifest already
        g.transact(lambda t: t.add_node(["P"], {"k": 4}))
    want, real = rows(g), getattr(Graph, step)

    def crash(self, *args):  # noqa: ANN001, ANN002
        if when == "after":
            real(self, *args)
        raise RuntimeError("crash")

    monkeypatch.setattr(Graph, step, crash)
    with pytest.raises(RuntimeError):
        g.checkpoint()
    monkeypatch.setattr(Graph, step, real)
    again = Graph.open(spark, g.path)
    assert rows(again) == want and again.next_vid == len(want)


def test_a_torn_manifest_is_passed_over(spark) -> None:  # noqa: ANN001
    n = Numbered(spark, scratch(spark, "m"))
    assert n.read() is None
    n.write({"a": 1})
    n.files.create(f"{n.path}/{2:019d}.json", b'{"content": {"a": 2}, "wh')
    assert n.read() == {"a": 1}
    n.write({"a": 3})
    assert n.read() == {"a": 3} and len(n._numbers()) == 2


def test_the_log_ends_at_the_first_torn_transaction(spark) -> None:  # noqa: ANN001
    for harm in ("commit", "records", "lost"):
        g = small(spark)
        for k in (4, 5):
            g.transact(lambda t, k=k: t.add_node(["P"], {"k": k}))
        d = g.journal.folder(2)
        if harm == "commit":
            g.journal.files.create(f"{d}/commit.json", b'{"txn": 2,', True)
        elif harm == "records":
            g.journal.files.create(f"{d}/records.json", g.journal.files.read(f"{d}/records.json")[:-9], True)
        else:
            g.journal.files.remove(f"{d}/commit.json")
        assert g.journal.read_from(1).filter("op = 'AddNode'").count() == 3
        again = Graph.open(spark, g.path)
        # what came after the torn one is not applied either, and new commits go on from there
        assert [r[2] for r in rows(again)] == [1, 2, 3] and again.journal.numbers() == [1]
        again.transact(lambda t: t.add_node(["P"], {"k": 9}))
        assert [r[2] for r in rows(Graph.open(spark, g.path))] == [1, 2, 3, 9]


def test_schema_is_logged(spark) -> None:  # noqa: ANN001
    g = small(spark)
    g.declare("node", "later", "double")
    g.declare("edge", "w", "int")
    g.add_constraint("exists", "P", "k")
    g.add_constraint("unique", "Q", "k")
    g.drop_constraint("unique:Q.k")
    g.create_index("by_k", "node", "k", unique=True, label="P")
    g.create_index("gone", "node", "k", mode="deferred")
    g.drop_index("gone")
    g.transact(lambda t: t.set_node_prop(0, "junk", "x"))
    g.drop_column("node", "junk")
    g.declare("node", "junk", "int")
    g.transact(lambda t: t.set_node_prop(1, "junk", 5))
    for again in (Graph.open(spark, g.path), (g.checkpoint(), Graph.open(spark, g.path))[1]):
        assert again.catalog.node_keys == {"k": "int", "later": "double", "junk": "int"} and again.catalog.edge_keys == {"w": "int"}
        assert [c.name for c in again.list_constraints()] == ["exists:P.k", "unique:P.k"] and [x.name for x in again.list_indexes()] == ["by_k"]
        assert {r.vid: r.p_junk for r in again.version.nodes.select("vid", column("junk")).collect()} == {0: None, 1: 5, 2: None}
        with pytest.raises(ConstraintViolation):
            again.transact(lambda t: t.add_node(["P"], {"k": 1}))
        with pytest.raises(SchemaError):
            again.declare("node", "later", "int")


def test_ids_given_twice_are_corruption(spark) -> None:  # noqa: ANN001
    def log(*records) -> Graph:  # noqa: ANN002
        g = small(spark)
        g.transact(lambda t: t.add_edge(0, 1, "e"))
        g.checkpoint()
        g.journal.append(g.txn + 1, g.current_lsn + 1, list(records))
        return g

    first = log().version.nodes.filter("vid = 0").first().logical_id
    assert first
    node = {"op": "AddNode", "labels": ["P"]}
    for bad in ([{**node, "vid": 1, "logical_id": "x"}], [{**node, "vid": 7, "logical_id": "x"}, {**node, "vid": 8, "logical_id": "x"}], [{"op": "AddEdge", "eid": 0, "src": 0, "dst": 1, "type": "e", "logical_id": "y"}]):
        with pytest.raises(CorruptionDetected):
            Graph.open(spark, log(*bad).path)
    g = small(spark)
    g.checkpoint()
    g.journal.append(g.txn + 1, g.current_lsn + 1, [{**node, "vid": 9, "logical_id": g.version.nodes.filter("vid = 0").first().logical_id}])
    with pytest.raises(CorruptionDetected):
        Graph.open(spark, g.path)
    g = small(spark)
    g.journal.append(g.txn + 1, g.current_lsn + 1, [], [{"op": "InternString", "kind": "label", "id": 5, "name": "Z"}])
    with pytest.raises(CorruptionDetected):
        Graph.open(spark, g.path)


def test_edges_are_checked_like_nodes(spark) -> None:  # noqa: ANN001
    g = small(spark)
    e = g.transact(lambda t: t.add_edge(0, 1, "e", {"w": 1}))
    for body in (lambda t: t.set_edge_prop(99, "w", 1), lambda t: t.del_edge_prop(99, "w"), lambda t: (t.del_edge(e), t.set_edge_prop(e, "w", 2)), lambda t: (t.del_node(0), t.set_edge_prop(e, "w", 2))):
        with pytest.raises(NotFound):
            g.transact(body)
    assert len(g.journal.numbers()) == 2
    g.transact(lambda t: t.set_edge_prop(t.add_edge(1, 2, "e"), "w", 7))
    g.create_index("by_w", "edge", "w", unique=True)
    with pytest.raises(ConstraintViolation):
        g.transact(lambda t: t.add_edge(0, 2, "e", {"w": 7}))
    assert g.transact(lambda t: t.add_edge(0, 2, "e", {"w": 8})) == 3  # ids of what failed are not used again
    assert [r.eid for r in g.get_index("by_w").equal(7).collect()] == [1]
    g.transact(lambda t: t.del_edge(12345))  # deleting what isn't there changes nothing


def test_ends_of_given_edges(spark) -> None:  # noqa: ANN001
    from graphloom.catalog import Catalog

    nodes = spark.createDataFrame([(0, ["A"]), (1, ["A"])], "vid long, labels array<string>")
    edges = spark.createDataFrame([(0, 0, 1, "T"), (1, 0, 9, "T")], "eid long, src long, dst long, type string")
    cat = lambda: Catalog({}, {}, ["A"], ["T"])
    with pytest.raises(NotFound):
        Graph.of(spark, nodes, edges, cat())
    count = lambda g, q: g.execute(f"MATCH {q} RETURN COUNT(*) AS n").first().n
    g = Graph.of(spark, nodes, edges, cat(), dangling="drop")
    assert count(g, "(a)-[:T]->(b)") == count(g, "(a)-[:T]->(b:A)") == 1
    g = Graph.of(spark, nodes, edges, cat(), dangling="keep")
    assert count(g, "(a)-[:T]->(b)") == count(g, "(a)-[:T]->(b:A)") == 1


def test_index_modes(spark) -> None:  # noqa: ANN001
    g = small(spark)
    for m in ("inline", "deferred", "incremental"):
        g.create_index(m, "node", "k", mode=m)
        g.get_index(m)
    for bad in (lambda: g.create_index("x", "node", "k", unique=True, mode="incremental"), lambda: g.create_index("x", "node", "k", mode="never"), lambda: g.create_index("x", "node", "s", value_type="string", mode="incremental")):
        with pytest.raises(DataError):
            bad()
    hits = lambda m, k: sorted(r.vid for r in g.get_index(m).equal(k).collect())
    g.transact(lambda t: (t.set_node_prop(0, "k", 3), t.del_node(1), t.add_node(["P"], {"k": 3})))
    assert hits("inline", 3) == hits("incremental", 3) == [0, 2, 3] and hits("incremental", 1) == hits("inline", 2) == hits("incremental", 2) == []
    assert hits("deferred", 3) == [2]
    g.flush_indexes()
    assert hits("deferred", 3) == [0, 2, 3]
    sizes = []
    g.on_index_size = lambda n, b: sizes.append((n, b))
    g.execute("MATCH (p:P) SET p.k = 5")
    assert hits("incremental", 5) == [0, 2, 3] and sizes and sizes[0][1] > 0
    assert [r.vid for r in g.find("k", 5).collect()] == [0, 2, 3] and g.find("k", 5, "Q").count() == 0 and g.find("k", 5.0).count() == 0


def test_durability_pins_and_thresholds(spark) -> None:  # noqa: ANN001
    g = small(spark)
    g.transact(lambda t: t.add_node(["P"], {"k": 4}), durability="group")
    assert len(Graph.open(spark, g.path).version.nodes.collect()) == 3 and len(rows(g)) == 4
    g.flush()
    assert rows(Graph.open(spark, g.path)) == rows(g)
    with pytest.raises(DataError):
        g.transact(lambda t: None, durability="maybe")
    with g.pin() as p:
        assert g.min_pinned_lsn == p.lsn == g.current_lsn == g.next_lsn - 1
        g.transact(lambda t: t.del_node(0))
        assert p.nodes().count() == 4 and g.view.nodes().count() == 3 and g.base.nodes().count() == 0 and g.has_pending
    assert g.min_pinned_lsn is None
    g.checkpoint_every(commits=3, size=None)
    for k in (5, 6, 7):
        g.transact(lambda t, k=k: t.add_node(["P"], {"k": k}))
    assert g.journal.size()[0] < 3 and g.journal.manifests.read()["lsn"] > 0
    assert rows(Graph.open(spark, g.path)) == rows(g)


def test_many_commits_stay_one_join_deep(spark) -> None:  # noqa: ANN001
    g = small(spark)
    for k in range(20):
        g.transact(lambda t, k=k: (t.set_node_prop(k % 3, "k", k), t.add_node(["P"], {"k": 100 + k})))
    plan = g.version.nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1 and g.version.nodes.count() == 23
    assert {r.p_k for r in g.version.nodes.filter("vid < 3").collect()} == {17, 18, 19}
    assert rows(Graph.open(spark, g.path)) == rows(g)


def test_stored_bounds_equal_counted_ones(spark) -> None:  # noqa: ANN001
    df = spark.range(200).select(F.col("id").alias("vid"), (F.col("id") % 7).alias("p_k"))
    a, b = PropertyIndex.of_table(df, "k", path=scratch(spark, "i") + "/t"), PropertyIndex.of_table(df, "k")
    for q in (-1, 0, 3, 6, 9):
        assert a.bounds(q).first() == b.bounds(q).first()
    flags = PropertyIndex.of_table(df.select("vid", (F.col("p_k") > 2).alias("p_k")), "k")
    assert flags.between(False, True).count() == flags.bounds(False).first().upper == flags.equal(False).count()


def test_journal_reader(spark) -> None:  # noqa: ANN001
    g = small(spark)
    g.bulk_add_edges(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), "e")
    j = Journal(spark, g.path)
    assert j.read_from(1).filter("op = 'AddEdge'").count() == 2 and j.read_from(g.current_lsn).filter("op = 'AddEdge'").count() == 0
    meta = json.loads(j.files.read(f"{j.folder(2)}/commit.json"))
    assert meta["n_records"] == 2 and meta["schema"][0] == {"op": "InternString", "kind": "edgeType", "id": 0, "name": "e"}
