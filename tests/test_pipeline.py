"""The general data operators: odd input, repeats, failures, and results against plain loops."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from graphloom.operators import eav, skew
from graphloom.operators import ledger as ledgers
from graphloom.operators.ledger import StaleLease, WorkLedger, advance, deliverable, outstanding, part, processed, ranges, unshipped
from graphloom.operators.orphans import orphan_report, orphans
from graphloom.session import scratch
from graphloom.streaming.changefeed import apply_node_feed

LOG = "lsn long, txn_id long, op string, vid long, logical_id string, label_ids array<int>, added array<int>, removed array<int>, key_id int, prop_value string, prev_value string, props string, eid long, src long, dst long, type_id int, commit_lsn long, written_at timestamp_ntz, arrived_at timestamp_ntz, segment_no int"
NAMES = [c.strip().split(" ")[0] for c in LOG.split(",")]
RUNS = "batch_id long, target_id string, run_no int, batch_no int, from_lsn long, to_lsn long, started_at timestamp_ntz, ended_at timestamp_ntz, outcome string"


def ts(n):  # noqa: ANN001, ANN201
    import datetime as dt

    return None if n is None else dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def log_of(spark, records):  # noqa: ANN001, ANN201
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in records], LOG)


def rec(lsn, txn, op, arrived=0, **x):  # noqa: ANN001, ANN003, ANN201
    return {"lsn": lsn, "txn_id": txn, "op": op, "arrived_at": ts(arrived), **({"commit_lsn": lsn} if op == "CommitTxn" else {}), **x}


# -- ledger
class Clock:
    now = 0.0

    def __call__(self) -> float:
        return self.now


def test_leases_expire_and_stale_writers_are_refused(spark) -> None:  # noqa: ANN001
    clock = Clock()
    w = WorkLedger(spark, scratch(spark, "w"), ttl=10, clock=clock)
    assert w.add("a", {"x": 1}) and not w.add("a") and w.state("a") == ("pending", 0)
    one = w.lease("one")
    assert one.payload == {"x": 1} and w.lease("two") is None and w.state("a") == ("leased", 1)
    clock.now = 11
    two = w.lease("two")
    assert two.token == 2
    with pytest.raises(StaleLease):
        w.finish(one, spark.range(1))
    w.finish(two, spark.range(5))
    assert w.state("a") == ("done", 2) and spark.read.parquet(w.output("a")).count() == 5
    with pytest.raises(StaleLease):
        w.finish(two, spark.range(7))
    assert spark.read.parquet(w.output("a")).count() == 5 and w.lease("three") is None
    with pytest.raises(ValueError):
        w.add("../b")


def test_each_record_is_processed_once_whatever_fails(spark) -> None:  # noqa: ANN001
    w = WorkLedger(spark, scratch(spark, "w"))
    source, fail = spark.range(1, 101).withColumnRenamed("id", "lsn"), {2}

    def work(lease):  # noqa: ANN001, ANN202
        if lease.payload["from"] in fail:
            fail.clear()
            raise RuntimeError("crash")
        return source.filter((F.col("lsn") > lease.payload["from"]) & (F.col("lsn") <= lease.payload["to"]))

    assert advance(w, source.filter("lsn <= 60"), step=25) == 3
    fail = {25}
    with pytest.raises(RuntimeError):
        w.run("me", work)
    w.run("me", work)
    assert advance(w, source, step=25) == 2 and advance(w, source, step=25) == 0
    w.run("me", work)
    got = [r.lsn for i in w.items() for r in spark.read.parquet(w.output(i)).collect()]
    assert sorted(got) == list(range(1, 101))


def test_late_and_late_committed_records_get_follow_up_items(spark) -> None:  # noqa: ANN001
    w = WorkLedger(spark, scratch(spark, "w"))
    # (3) arrives late, (4) is committed late, 5's commit arrives late with a low lsn, (1) lies beneath all
    records = [rec(10, 1, "AddNode", 1), rec(11, 1, "CommitTxn", 2), rec(12, 2, "AddNode", 1), rec(30, 3, "AddNode", 1), rec(31, 3, "CommitTxn", 2), rec(10, 1, "AddNode", 9)]
    records += [rec(9, 1, "AddNode", 12), rec(40, 2, "CommitTxn", 12), rec(15, 5, "AddNode", 1), rec(16, 5, "CommitTxn", 12)]
    records += [rec(2, 6, "AddNode", 20), rec(3, 6, "CommitTxn", 21), rec(13, 7, "AddNode", 21), rec(14, 7, "CommitTxn", 20)]

    def turn(upto):  # noqa: ANN001, ANN202
        source = deliverable(log_of(spark, [r for r in records if r["arrived_at"] <= ts(upto)]))
        n = advance(w, source, "commit_lsn", step=10)
        assert advance(w, source, "commit_lsn", step=10) == 0
        return n, lambda lease: part(source, lease.payload, "commit_lsn").select("lsn")

    def done():  # noqa: ANN202
        return sorted(r.lsn for i in w.items() if w.state(i)[0] == "done" for r in spark.read.parquet(w.output(i)).collect())

    n, work = turn(5)
    w.run("me", work)
    assert n == 3 and done() == [10, 30]
    assert turn(10)[0] == 0  # a record delivered again is none that is new
    n, work = turn(15)
    w.run("me", work)
    assert n == 2 and done() == [9, 10, 12, 15, 30]
    turn(18)
    n, work = turn(30)  # into a range that has a follow-up already, and beneath the lowest
    w.run("me", work)
    assert n == 2 and done() == [2, 9, 10, 12, 13, 15, 30] == sorted({r["lsn"] for r in records if r["op"] == "AddNode"})
    with pytest.raises(ValueError):
        advance(w, spark.createDataFrame([(50, None)], "commit_lsn long, arrived_at timestamp_ntz"), "commit_lsn")


def test_unshipped_against_a_loop(spark) -> None:  # noqa: ANN001
    r = random.Random(3)
    records = []
    for t in range(1, 30):
        records += [rec(10 * t + i, t, "AddNode", r.randrange(300)) for i in range(r.randrange(1, 5))]
        if r.random() < 0.8:
            records.append(rec(10 * t + 9, t, "CommitTxn", 5))
    records += r.sample(records, 20) + [rec(5000, 77, "AddNode", None), rec(5001, 77, "CommitTxn"), rec(None, 1, "AddNode"), rec(6000, None, "AddNode")]
    runs = []
    for b in range(40):
        lo = r.randrange(0, 250)
        runs.append((b, r.choice(["x", "y"]), 1, b, lo, lo + r.randrange(0, 80), ts(r.choice([50, 150, 400, None])), None, r.choice(["acked", "acked", "rejected", "crashed", None])))
    runs += [runs[3], (99, None, 1, 1, 0, 10**6, ts(999), None, "acked"), (98, "z", 1, 1, None, 7, ts(1), None, "acked")]
    first, commit = {}, {x["txn_id"]: x["commit_lsn"] for x in records if x["op"] == "CommitTxn"}
    for x in records:
        if x["op"] == "AddNode" and x["lsn"] is not None and x["txn_id"] in commit:
            a = first.setdefault(x["lsn"], [x["txn_id"], x["arrived_at"]])
            if a[1] is None or x["arrived_at"] is not None and x["arrived_at"] < a[1]:
                a[1] = x["arrived_at"]
    want = set()
    for t in ("x", "y", "z"):
        for lsn, (txn, a) in first.items():
            c = commit[txn]
            done = any(b[1] == t and b[8] == "acked" and None not in (b[4], b[6], a) and b[4] < c <= b[5] and b[6] >= a for b in runs)
            if not done:
                want.add((t, lsn))
    got = [tuple(x) for x in unshipped(log_of(spark, records), spark.createDataFrame(runs, RUNS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert unshipped(log_of(spark, []), spark.createDataFrame(runs, RUNS)).count() == 0
    assert unshipped(log_of(spark, records), spark.createDataFrame([], RUNS)).count() == 0
    assert ranges(spark.createDataFrame([], RUNS)).count() == 0


def test_items_fold_leases_by_token(spark) -> None:  # noqa: ANN001
    run = lambda b, lo, hi, start, end, outcome, t="x": (b, t, 1, b, lo, hi, ts(start), ts(end), outcome)
    runs = [run(7, 0, 10, 500, 900, "acked"), run(3, 0, 10, 100, 990, "acked")]  # 3 is stale: its end is the later one
    runs += [run(4, 10, 20, 600, None, "crashed"), run(5, 10, 20, 610, 620, "rejected"), run(6, 20, 30, 100, None, None), run(8, 30, 40, 950, None, None)]
    runs += [run(9, 35, 40, 960, 970, "rejected"), run(9, 35, 40, 960, 970, "rejected"), run(1, 5, 7, 999, None, "crashed"), run(2, 0, 50, 1, 2, "acked", "y")]
    got = {(r.target, r.lo, r.hi): (r.state, r.token, r.done_at) for r in ranges(spark.createDataFrame(runs, RUNS), ttl=100).collect()}
    at = {k[1]: v[:2] for k, v in got.items() if k[0] == "x" and 0 <= k[1] < 40}
    # 6 has expired; 8 still holds its range but where 9 came after it; 1 cannot undo what 7 did
    assert at == {0: ("done", 7), 5: ("done", 7), 7: ("done", 7), 10: ("pending", 5), 20: ("pending", 6), 30: ("leased", 8), 35: ("pending", 9)}
    assert got[("y", 0, 50)][:2] == ("done", 2) and got[("x", 0, 5)][2].replace(tzinfo=None) == ts(500)
    records = spark.createDataFrame([(1, 3, ts(499)), (2, 3, ts(501)), (3, 33, ts(1)), (4, 99, None)], "lsn long, commit_lsn long, arrived_at timestamp_ntz")
    left = lambda: sorted((r.target, r.lsn) for r in outstanding(records, ranges(spark.createDataFrame(runs, RUNS))).collect())
    # an ack whose start lies before the arrival leaves the record to a follow-up; y was acked from second 1 on
    assert left() == [("x", 2), ("x", 3), ("x", 4), ("y", 1), ("y", 2), ("y", 4)]


def test_very_many_targets(spark) -> None:  # noqa: ANN001
    n = 20_000
    runs = spark.range(n).select(F.col("id").alias("batch_id"), F.concat(F.lit("t"), F.col("id")).alias("target_id"), F.lit(0).cast("long").alias("from_lsn"), (F.col("id") % 10 + 1).alias("to_lsn"), F.lit(ts(10)).alias("started_at"), F.lit(ts(20)).alias("ended_at"), F.lit("acked").alias("outcome"))
    log = log_of(spark, [x for k in range(1, 6) for x in (rec(100 + k, k, "AddNode", 1), {**rec(200 + k, k, "CommitTxn", 1), "commit_lsn": 2 * k})])
    out = unshipped(log, runs)
    # a target that was acked up to m lacks the commits above m
    want = sum(n // 10 for m in range(1, 11) for k in range(1, 6) if 2 * k > m)
    assert out.count() == want and out.distinct().count() == want


def test_wide_lookup_equals_the_broadcast_one(spark) -> None:  # noqa: ANN001
    r = random.Random(8)
    runs = spark.createDataFrame([(b, r.choice("xyz"), 1, b, lo := r.randrange(200), lo + r.randrange(60), ts(r.randrange(99)), ts(99), r.choice(["acked", "crashed"])) for b in range(60)], RUNS)
    records = spark.createDataFrame([(i, r.randrange(300), ts(r.randrange(99))) for i in range(300)], "lsn long, commit_lsn long, arrived_at timestamp_ntz")
    rows = lambda: sorted(map(tuple, outstanding(records, ranges(runs)).select("target", "lsn").collect()))
    want, limit = rows(), ledgers.BROADCAST_RANGES
    try:
        ledgers.BROADCAST_RANGES = 0
        assert rows() == want and len(want) > 300
    finally:
        ledgers.BROADCAST_RANGES = limit


def test_events_that_are_not_whole(spark) -> None:  # noqa: ANN001
    clock = Clock()
    w = WorkLedger(spark, scratch(spark, "w"), ttl=10, clock=clock)
    w.add("a", {"x": 1})
    w.fs.create(w.Path(f"{w.path}/items/a/{1:09d}.json"), False).close()  # a writer died while it took a lease
    lease = w.lease("me")
    assert lease.payload == {"x": 1}
    w.fs.create(w.Path(f"{w.path}/items/a/{3:09d}.json"), False).close()  # and another while it finished
    assert w.state("a") == ("leased", 1)
    w.finish(lease, spark.range(3))
    assert w.state("a")[0] == "done" and spark.read.parquet(w.output("a")).count() == 3
    w.fs.create(w.Path(f"{w.path}/items/b/{0:09d}.json"), False).close()  # what an item means is stored before it is there
    assert not w.add("b") and w.lease("me", "c") is None


def test_processed_has_every_record_once(spark) -> None:  # noqa: ANN001
    r = random.Random(12)
    records = [rec(100 + i, i % 40, "AddNode", r.randrange(500)) for i in range(200)] + [rec(1000 + t, t, "CommitTxn", r.randrange(500)) for t in range(0, 40, 2)]
    records += r.sample(records, 50)
    got = sorted(x.lsn for x in processed(log_of(spark, records), scratch(spark, "w"), waves=3).collect())
    assert got == sorted({x["lsn"] for x in records if x["op"] == "AddNode" and x["txn_id"] % 2 == 0})
    assert processed(log_of(spark, []), scratch(spark, "w")).count() == 0


# -- orphans
EDGES = "logical_id string, edge_type string, src_logical_id string, dst_logical_id string, props string, remote_id string, created_at timestamp_ntz, loaded_at timestamp_ntz"
NODES = "logical_id string, vid long, labels array<string>, props string, remote_id string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz"
U = [f"018d4d5d-a800-776a-a25c-a9674bfda1a{i}" for i in range(6)]


def test_orphans(spark) -> None:  # noqa: ANN001
    nodes = [(U[0], 10, None, None, None, ts(0), None, ts(5)), (U[0], 10, None, None, None, ts(0), None, ts(900)), (U[1], 11, None, None, None, ts(0), ts(50), ts(1)), (U[2], 12, None, None, None, ts(0), None, ts(500)), (None, None, None, None, None, None, None, None)]
    spell = [U[0].upper(), U[0].replace("-", ""), "urn:uuid:" + U[0], "{" + U[0].upper() + "}", U[0] + "\n", "\t" + U[0], "local-10"]
    edges = [(f"ok{i}", "t", s, U[0], None, None, ts(100), ts(100)) for i, s in enumerate(spell)]
    edges += [("gone", "t", U[1], None, None, None, ts(50), ts(60)), ("before", "t", "local-11", None, None, None, ts(49), ts(60)), ("late", "t", U[2], U[3], None, None, ts(100), ts(100)), ("late", "t", U[2], U[3], None, None, ts(100), ts(700)), ("none", None, "local-99", "", None, None, None, None)]
    e, n = spark.createDataFrame(edges, EDGES).withColumn("key", F.lit("clash")), spark.createDataFrame(nodes, NODES)
    got = sorted((tuple(r) for r in orphans(e, n).collect()), key=str)
    want = [("gone", "src", "deleted", "2025-01"), ("late", "src", "late", "2025-01"), ("late", "dst", "missing", "2025-01"), ("none", "src", "missing", None), ("none", "dst", "missing", None)]
    assert got == sorted(want, key=str)
    assert orphan_report(e, n).agg(F.sum("n")).first()[0] == 5
    assert orphans(e.limit(0), n).count() == 0 and orphans(e, n.limit(0)).count() > 10


# -- skew
def test_edge_profile_with_a_hot_key_and_odd_ids(spark) -> None:  # noqa: ANN001
    r = random.Random(5)
    refs = ["hub"] * 5 + [f"n{i}" for i in range(8)] + [None, "", U[0], U[0].upper(), U[0] + "\n", "é" * 3]
    rows = [(r.choice(["i1", "i2", None, *(f"e{i}" for i in range(60))]), r.choice(refs), r.choice(refs)) for _ in range(400)]
    want: dict = {}
    for i, a, b in rows:
        for end, x, y in (("src", a, b), ("dst", b, a)):
            if x is not None:
                ids, peers = want.setdefault((end, x), (set(), set()))
                ids.add(i)
                peers |= {y} - {None}
    df = spark.createDataFrame(rows, "logical_id string, src_logical_id string, dst_logical_id string").withColumn("n", F.lit(1))
    got = {(x.edge_end, x.node_ref): (x.n_edges, x.n_peers) for x in skew.edge_profile(df).collect()}
    assert got == {k: (len(i), len(p)) for k, (i, p) in want.items()}
    assert skew.edge_profile(df.limit(0)).count() == 0


def test_modes_and_percentiles(spark) -> None:  # noqa: ANN001
    r = random.Random(6)
    rows = [("hot", int(r.gauss(0, 1000))) for _ in range(3000)] + [(k, r.choice([1, 2, 2, None])) for k in "abc" for _ in range(9)] + [("null", None), (None, 4), ("one", 7)]
    f = skew.frequencies(spark.createDataFrame(rows, "k string, v long"), "k", "v")
    by: dict = {}
    for k, v in rows:
        if k is not None:
            by.setdefault(k, []).extend([v] if v is not None else [])
    import math

    got = {(x.key, x.p): x.value for x in skew.percentiles(f, [0.0, 0.5, 0.99, 1.0], strips=8).collect()}
    assert got == {(k, p): sorted(v)[max(math.ceil(p * len(v)), 1) - 1] for k, v in by.items() if v for p in (0.0, 0.5, 0.99, 1.0)}
    s = {x.key: (x.n, x.n_distinct, x.mode) for x in skew.summary(f).collect()}
    assert s == {k: (len(v), len(set(v)), min(set(v), key=lambda x: (-v.count(x), x)) if v else None) for k, v in by.items()}
    assert skew.heavy_keys(f.groupBy("key").agg(F.sum("n").alias("n")), len(rows), 0.5) == ["hot"]


# -- change feed and wide tables
def feed(r, n=400):  # noqa: ANN001, ANN201
    """A random log with interleaved, uncommitted and single-record transactions."""
    out, lsn, values = [], 0, ["1", "-2.0", "1e2", '"3"', '" 4 "', '"x"', "null", "true", '" TRUE "', "[1]", '{"a": 1}', "1.5", '"1.25"', '"NaN"', '"a\\u00e9 \\"q\\""', "oops", "0.001", "1e-30", "99999999999999999999", '""']
    open_txns: dict[int, int] = {}
    for t in range(1, n):
        lsn += r.randrange(1, 3)
        if len(open_txns) < 4:
            open_txns[t] = r.randrange(1, 6)
        txn = r.choice(list(open_txns))
        if open_txns[txn] == 0:
            del open_txns[txn]
            if r.random() < 0.9:
                out.append(rec(lsn, txn, "CommitTxn"))
            continue
        open_txns[txn] -= 1
        vid, op = r.randrange(25), r.choice(["AddNode", "AddNode", "SetNodeProp", "SetNodeProp", "SetNodeLabels", "DelNodeProp", "DelNode", "AddEdge"])
        x: dict = {"vid": vid}
        if op == "AddNode":
            x |= {"logical_id": f"id{lsn}", "label_ids": r.choice([[1], [2, 3], [], None, [11, 2]]), "props": r.choice([None, "{}", "oops", '{"1": 1.50, "2": "7", "3": [1], "9": 4}', '{"2": 12, "3": null, "4": true, "x": 1}'])}
        elif op == "SetNodeLabels":
            x |= {"added": r.choice([None, [1], [2, 5]]), "removed": r.choice([None, [2], [1, 3]])}
        elif op in ("SetNodeProp", "DelNodeProp"):
            x |= {"key_id": r.choice([1, 2, 3, 4, 50]), "prop_value": r.choice(values) if op == "SetNodeProp" else None}
        out.append(rec(lsn, txn, op, **x))
    return out


def replayed(records):  # noqa: ANN001, ANN201
    """The nodes after a plain loop: an AddNode replaces, anything else needs the node."""
    import json

    done = {x["txn_id"] for x in records if x["op"] == "CommitTxn"}
    st: dict = {}
    for x in sorted({x["lsn"]: x for x in records}.values(), key=lambda x: x["lsn"]):
        v, op = x.get("vid"), x["op"]
        if x["txn_id"] not in done or v is None or op not in ("AddNode", "DelNode", "SetNodeLabels", "SetNodeProp", "DelNodeProp"):
            continue
        if op == "AddNode":
            try:
                props = {int(k): w for k, w in json.loads(x["props"] or "{}", parse_int=lambda s: ("n", s), parse_float=lambda s: ("n", s)).items() if k.isdigit()}
            except ValueError:
                props = {}
            st[v] = {"id": x["logical_id"], "labels": set(x["label_ids"] or []), "props": props, "lsn": x["lsn"]}
            continue
        if v not in st:
            continue
        if op == "DelNode":
            del st[v]
            continue
        st[v]["lsn"] = x["lsn"]
        if op == "SetNodeLabels":
            st[v]["labels"] = (st[v]["labels"] - set(x["removed"] or [])) | set(x["added"] or [])
        elif op == "DelNodeProp":
            st[v]["props"].pop(x["key_id"], None)
        else:
            try:
                w = json.loads(x["prop_value"], parse_int=lambda s: ("n", s), parse_float=lambda s: ("n", s))
            except ValueError:
                w = None
            st[v]["props"][x["key_id"]] = w
    return st


def cell(v, t):  # noqa: ANN001, ANN201
    import re

    if v is None or isinstance(v, (dict, list)):
        return None
    number = isinstance(v, tuple)
    text = v[1] if number else v
    if t == "string":
        return ("true" if v else "false") if isinstance(v, bool) else text
    if t == "bool":
        return str(v).lower() if isinstance(v, bool) else None if number or text.strip().lower() not in ("true", "false") else text.strip().lower()
    if isinstance(v, bool) or not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text.strip()):
        return None
    d = Decimal(text.strip())
    if t == "int":
        return str(int(d)) if d == d.to_integral_value() and abs(d) < 2**63 else None
    return str(int((d * 1000).to_integral_value()))


KEYS = [(1, "a", "node", "double"), (2, "a", "node", "int"), (3, "vid", "node", "string"), (4, "B", "node", "bool"), (50, "e", "edge", "int"), (None, "z", "node", "int")]


@pytest.mark.parametrize("seed", [1, 2])
def test_feed_and_cells_against_a_loop(spark, seed: int) -> None:  # noqa: ANN001
    r = random.Random(seed)
    records = feed(r)
    st = replayed(records)
    delivered = records + r.sample(records, 60)
    r.shuffle(delivered)
    path = scratch(spark, "feed") + "/wal_ops"
    for i in range(0, len(delivered), 100):
        log_of(spark, delivered[i : i + 100]).coalesce(1).write.mode("append").parquet(path)
    out = scratch(spark, "out")
    got = {tuple(x) for x in apply_node_feed(spark, path, out, files_per_batch=1, compact=2).collect()}  # several compactions
    assert got == {(v, x["id"], ",".join(map(str, sorted(x["labels"]))), x["lsn"]) for v, x in st.items()}
    # more of the log arrives: a late record, repeats, a commit of what was held back
    held = sorted({x["txn_id"] for x in records} - {x["txn_id"] for x in records if x["op"] == "CommitTxn"})
    more = [rec(100_000 + t, t, "CommitTxn") for t in held] + records[:30]
    log_of(spark, more).write.mode("append").parquet(path)
    st2 = replayed(records + more)
    got = {tuple(x) for x in apply_node_feed(spark, path, out, compact=2).collect()}
    assert got == {(v, x["id"], ",".join(map(str, sorted(x["labels"]))), x["lsn"]) for v, x in st2.items()}

    keys = spark.createDataFrame(KEYS, "key_id int, key_name string, owner_kind string, value_type string")
    log = log_of(spark, delivered).withColumn("kind", F.lit(1)).withColumn("raw", F.lit(2))
    wide, attrs = eav.wide_nodes(log, keys)
    types = {a.key_id: a.type for a in attrs}
    assert types == {1: "double", 2: "int", 3: "string", 4: "bool"}
    want = {(v, k, c) for v, x in st.items() for k, w in x["props"].items() if k in types and (c := cell(w, types[k])) is not None}
    exact = lambda cells: {x for x in cells if x[1] != 1 or len(x[2]) < 17}  # noqa: E731  a double has no more digits
    assert exact(tuple(x) for x in eav.cells(wide, attrs).collect()) == exact(want)
    named = eav.named(wide, attrs)
    assert named.columns == ["vid", "a", "a_2", "vid_3", "B"] and named.count() == len(st)
    option = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    assert spark.conf.get(option, "false") == "false" and not [t for t in spark.catalog.listTables() if t.name.startswith("narrow_")]
    nodes = spark.createDataFrame([(v,) for v in range(30)], "vid long")
    values = spark.createDataFrame([(v, k, 1, "n", str(v + k)) for v in range(30) for k in (1, 2, 3)], "vid long, key_id int, lsn long, kind string, raw string")
    with eav.NarrowTables(values, nodes, attrs) as t:
        plan = t.wide()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan and t.wide().count() == 30


def test_empty_log(spark) -> None:  # noqa: ANN001
    path = scratch(spark, "feed") + "/wal_ops"
    log_of(spark, []).write.parquet(path)
    assert apply_node_feed(spark, path, scratch(spark, "out")).count() == 0
    keys = spark.createDataFrame(KEYS, "key_id int, key_name string, owner_kind string, value_type string")
    assert eav.node_cells(log_of(spark, []), keys).count() == 0
    assert eav.node_cells(log_of(spark, []), keys.limit(0)).count() == 0
