"""The exported tables as a graph, against plain loops."""

from __future__ import annotations

import datetime as dt
import json

import __spark_entry__ as entry
from graphloom import api
from graphloom.sources.commerce import exported

NODES = "logical_id string, vid long, labels array<string>, props string, remote_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz"
EDGES = "logical_id string, edge_type string, src_logical_id string, dst_logical_id string, props string, remote_id string, created_at timestamp_ntz, loaded_at timestamp_ntz"
KEYS = "key_id int, key_name string, owner_kind string, value_type string"
U = [f"018d4d5d-a800-776a-a25c-a9674bfda1a{i}" for i in range(4)]


def ts(n: int) -> dt.datetime:
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def folder_of(spark, path, nodes, edges, keys=()) -> str:  # noqa: ANN001
    for name, rows, schema in (("graph_nodes", nodes, NODES), ("graph_edges", edges, EDGES), ("prop_keys", list(keys), KEYS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_edges_are_kept_however_their_ends_are_written(spark, tmp_path) -> None:  # noqa: ANN001
    nodes = [(u, 10 + i, ["Person"], None, None, ts(0), ts(9) if i == 3 else None, ts(5)) for i, u in enumerate(U)]
    spell = [U[1], U[1].upper(), U[1].replace("-", ""), "{" + U[1].upper() + "}", "urn:uuid:" + U[1], "local-11"]
    edges = [(f"e{i}", "knows", s, "local-10" if i % 2 else U[0].upper(), None, None, ts(1), ts(2)) for i, s in enumerate(spell)]
    edges += [edges[0], ("e1", "knows", U[1], U[0], None, None, ts(1), ts(3))]  # repeated, once in other spellings
    edges += [("x0", "knows", "local-99", U[0], None, None, ts(1), ts(2)), ("x1", "knows", U[3].upper(), U[0], None, None, ts(1), ts(2)), ("x2", "knows", None, U[0], None, None, ts(1), ts(2))]
    v = exported(spark, folder_of(spark, tmp_path, nodes, edges))
    assert [tuple(r)[:2] for r in v.edges().collect()] == [(11, 10)] * len(spell)
    assert tuple(api.counts(v).first())[:2] == (3, len(spell))
    assert {r.vid: (r.out_degree, r.in_degree) for r in api.degrees(v).collect()} == {10: (0, 6), 11: (6, 0), 12: (0, 0)}


def test_seed_and_export_keep_all_declared_properties(spark, tmp_path) -> None:  # noqa: ANN001
    keys = [(0, "name", "node", "string"), (1, "depth", "node", "int"), (2, "online", "node", "bool"), (3, "battery level", "node", "double"), (40, "weight", "edge", "double"), (41, "since", "edge", "int"), (42, "role", "edge", "string"), (43, "confirmed", "edge", "bool")]
    old, new = '{"name":"a","depth":1}', '{"name":"b","depth":-7,"online":"TRUE","battery level":2.50,"other":1}'
    nodes = [(U[0], 10, ["Topic"], old, None, ts(0), None, ts(5)), (U[0], 10, ["Topic"], new, None, ts(0), None, ts(6)), (U[1], 11, ["Person"], '{"name":null,"depth":"x","online":1,"battery level":"NaN"}', None, ts(0), None, ts(5))]
    edge = '{"weight":0.96,"since":2015,"role":"kindly","confirmed":false}'
    edges = [("e", "knows", U[0], "local-11", edge, None, ts(1), ts(2)), ("e", "knows", U[0], U[1], edge, None, ts(1), ts(3)), ("f", "knows", U[0], U[1], None, None, ts(1), ts(3))]
    d = folder_of(spark, tmp_path, nodes, edges, keys)
    q = entry.queries()
    flat = lambda d: sorted(f"{k}={v if isinstance(v, str) else json.dumps(v)}" for k, v in d.items())
    want = {"name": "b", "depth": -7, "online": True, "battery level": 2.5}
    assert {r.logical_id: r.props for r in q["sync_seed_nodes"](spark, d).collect()} == {U[0]: flat(want), U[1]: []}
    assert [r.props for r in q["export_subgraph"](spark, d).collect()] == [flat(want)]
    assert [json.loads(r.props) for r in api.export_nodes(exported(spark, d), ["Topic"]).collect()] == [want]
    got = sorted(((r.src, r.dst, r.type, r.props) for r in q["sync_seed_edges"](spark, d).collect()), key=str)
    assert got == sorted([(10, 11, "knows", flat(json.loads(edge))), (10, 11, "knows", [])], key=str)
