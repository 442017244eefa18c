"""Walks from every node of a table, against plain loops."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry


def distances(steps, start):  # noqa: ANN001, ANN201
    seen, now = {start: 0}, [start]
    while now:
        now = [b for a in now for b in steps[a] if b not in seen and not seen.update({b: seen[a] + 1})]
    return seen


@pytest.mark.parametrize(("name", "lo", "hi"), [("var_upto", 1, 2), ("var_from", 2, 10**9)])
def test_walks_from_all_events(spark, sf, name, lo, hi) -> None:  # noqa: ANN001
    of, steps = defaultdict(list), defaultdict(list)
    for e in spark.read.parquet(f"{sf}/events.parquet").filter("user_id is not null").select("event_id", "user_id", "ts").collect():
        of[e.user_id].append((e.ts, e.event_id))
    for x in of.values():
        x.sort()
        for (_, a), (_, b) in zip(x, x[1:], strict=False):
            steps[a].append(b)
    far = {a: distances(steps, a).values() for a in list(steps)}
    want = {a: n for a, d in far.items() if (n := sum(lo <= x <= hi for x in d))}
    assert max(want) >= 100 and {r.s: r.n for r in entry.queries()[name](spark, sf).collect()} == want


def test_undirected_walks_from_all_suppliers(spark, sf) -> None:  # noqa: ANN001
    steps = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct().collect():
        steps["Supplier", r[0]].add(("Part", r[1]))
        steps["Part", r[1]].add(("Supplier", r[0]))
    three, two = Counter(), Counter()
    for s in [k for k in list(steps) if k[0] == "Supplier"]:
        for (label, _), d in distances(steps, s).items():
            three[s[1], label] += 1 <= d <= 3
            two[s[1]] += d == 2 and label == "Supplier"
    assert len(two) > 1
    assert {(r.s, r.l[0]): r.n for r in entry.queries()["var_undirected"](spark, sf).collect()} == {k: n for k, n in three.items() if n}
    assert {r.s: r.n for r in entry.queries()["var_distance_two"](spark, sf).collect()} == {k: n for k, n in two.items() if n}


def test_doubling_and_hops_agree(spark) -> None:  # noqa: ANN001
    from graphloom.plans.walk import reach

    # a chain, two cycles, one with a tail, a self-loop: every node has one successor
    succ = {i: i + 1 for i in range(12)} | {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 200: 201, 201: 200, 300: 300}
    edges = spark.createDataFrame(list(succ.items()), "src long, dst long")
    starts = spark.createDataFrame([(i,) for i in [*succ, 999]], "start long")
    steps = defaultdict(list, {a: [b] for a, b in succ.items()})
    for lo, hi in ((2, None), (0, 5)):
        want = {(a, b, d) for a in succ for b, d in distances(steps, a).items() if d >= max(lo, 1) and (hi is None or d <= hi)}
        assert {tuple(r) for r in reach(starts, edges, lo, hi).collect()} == want
    both = edges.union(spark.createDataFrame([(0, 100), (5, 3)], "src long, dst long"))  # no longer one successor each
    steps[0].append(100)
    steps[5].append(3)
    want = {(a, b, d) for a in succ for b, d in distances(steps, a).items() if d >= 1}
    assert {tuple(r) for r in reach(starts, both, 1, None).collect()} == want
    from graphloom.errors import EvalError

    for e in (edges, both):
        with pytest.raises(EvalError):
            reach(starts, e, 1, None, max_hops=3)


def test_walks_from_several_blocks_agree_with_loops(spark) -> None:  # noqa: ANN001
    import random

    from pyspark.sql import functions as F

    from graphloom.plans.walk import reach, reach_counts

    r = random.Random(5)
    edges = {(r.randrange(150), r.randrange(150)) for _ in range(500)} | {(7, 7)}
    both = edges | {(b, a) for a, b in edges}
    starts = spark.createDataFrame([(i,) for i in range(200)], "start long").repartition(3)  # some without an edge
    ends = spark.range(100).select(F.col("id").alias("node"), (F.col("id") % 3).alias("k"))
    for pairs, symmetric, lo, hi in ((edges, False, 1, 3), (both, True, 2, None)):
        steps = defaultdict(list)
        for a, b in pairs:
            steps[a].append(b)
        df = spark.createDataFrame(sorted(pairs) * 2, "src long, dst long")
        want = {(a, b, d) for a in range(200) for b, d in distances(steps, a).items() if d >= lo and (hi is None or d <= hi)}
        found = reach(starts, df, lo, hi, symmetric=symmetric).collect()
        assert len(found) == len(want) and {tuple(x) for x in found} == want
        by = Counter((a, b % 3) for a, b, _ in want if b < 100)
        assert {tuple(x) for x in reach_counts(starts, df, lo, hi, symmetric=symmetric, ends=ends, by=("k",)).collect()} == {(*k, n) for k, n in by.items()}


def test_starts_that_meet_the_same_nodes_share_rows(spark) -> None:  # noqa: ANN001
    import glob
    import random

    from graphloom.catalog import Catalog
    from graphloom.model import EdgeSource, GraphView, NodeSource
    from graphloom.plans.query import run
    from graphloom.session import shared_root

    # 130 of A, two of each value, give to 400 of B, so that all of them meet within three hops; one of A gives nothing
    a, b = 131, 400
    given = {(i, 1000 + x) for i in range(a - 1) for x in random.Random(i).sample(range(b), 40)}
    steps = defaultdict(list)
    for x, y in given:
        steps[x].append(y)
        steps[y].append(x)
    nodes = [NodeSource(spark.createDataFrame([(i, i // 2) for i in range(a)], "vid long, p_k long"), ("A",), (), ("k",)), NodeSource(spark.range(1000, 1000 + b).withColumnRenamed("id", "vid"), ("B",))]
    edges = EdgeSource(spark.createDataFrame(sorted(given), "src long, dst long"), ("GIVES",), ("A",), ("B",))
    view = GraphView(spark, Catalog({"k": "int"}, {}, ["A", "B"], ["GIVES"]), nodes, [edges])
    two, three = Counter(), Counter()
    for i in range(a):
        for x, d in distances(steps, i).items():
            two[i // 2] += d == 2
            three[i // 2, "A" if x < 1000 else "B"] += 1 <= d <= 3
    pairs = sum(three.values())
    root = shared_root(spark).removeprefix("file://") + "/graphloom/walk-"
    before = set(glob.glob(f"{root}*"))
    got = run(view, "MATCH (s:A)-[:GIVES*1..3]-(x) RETURN s.k AS k, labels(x) AS l, COUNT(*) AS n").collect()
    assert len(got) == len({(r.k, r.l[0]) for r in got}) and {(r.k, r.l[0]): r.n for r in got} == {k: n for k, n in three.items() if n}
    (new,) = set(glob.glob(f"{root}*")) - before
    written = sum(spark.read.parquet(f"{new}/{i}").count() for i in range(4))
    assert pairs > 60_000 and written < pairs / 10
    assert {r.k: r.n for r in run(view, "MATCH (s:A)-[:GIVES*2]-(x:A) RETURN s.k AS k, COUNT(*) AS n").collect()} == {k: n for k, n in two.items() if n}
    # of the ends more than their labels is used, or they have to carry a value: counted and not
    met = Counter()
    for i in range(a):
        met.update(x // 2 for x, d in distances(steps, i).items() if d == 2)
    assert {r.k: r.n for r in run(view, "MATCH (s:A)-[:GIVES*2]-(x:A) RETURN x.k AS k, COUNT(x) AS n").collect()} == met
    for text in ("MATCH (s:A)-[:GIVES*2]-(x {k: 3}) RETURN COUNT(*) AS n", "MATCH (s:A)-[:GIVES*2]-(x) WHERE x.k = 3 RETURN COUNT(*) AS n"):
        assert run(view, text).first().n == met[3]
