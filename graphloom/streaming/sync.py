"""Ship a log to targets: seed once, then what is new since the last acknowledged record.

Only added nodes and edges are shipped, nodes by their logical id and edges by those of their ends.
A target's mark moves only with an acknowledged batch; a batch that is refused is put aside with its
reason and the run stops there, so nothing after it is taken for shipped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError, RemoteError
from ..journal import Numbered
from ..session import written
from ..sources.log import committed

BATCH = 1024


def shippable(log: DataFrame, names: DataFrame, after: int = 0, unlabelled: str | None = "unlabeled_node") -> DataFrame:
    """(lsn, op, logical_id, labels, edge_type, src, dst) of committed AddNode and AddEdge records beyond ``after``.

    ``names`` (name_kind, int_id, interned) gives labels and edge types. A node without labels gets
    ``unlabelled``, or is an error if that is None. An edge whose end was never added has a null there.
    """
    rec = committed(log.filter("op in ('AddNode', 'AddEdge')").select("lsn", "txn_id", "op", "vid", "eid", "logical_id", "label_ids", "src", "dst", "type_id").dropDuplicates(["lsn"]), log)
    new = rec.filter(F.col("lsn") > after)
    label = names.filter("name_kind = 'label'").select(F.col("int_id").alias("id"), "interned")
    by_lsn = new.select("lsn", F.explode("label_ids").alias("id")).join(label, "id").groupBy("lsn").agg(F.sort_array(F.collect_set("interned")).alias("labels"))
    fallback = F.array(F.lit(unlabelled)) if unlabelled is not None else F.raise_error(F.lit("a node has no label"))
    nodes = new.filter("op = 'AddNode'").join(by_lsn, "lsn", "left").select("lsn", "op", "logical_id", F.when(F.col("labels").isNotNull(), F.col("labels")).otherwise(fallback).alias("labels"))
    types = names.filter("name_kind = 'edgeType'").select(F.col("int_id").alias("type_id"), F.col("interned").alias("edge_type"))
    ids = rec.filter("op = 'AddNode'").groupBy("vid").agg(F.max_by("logical_id", "lsn").alias("logical"))
    edges = new.filter("op = 'AddEdge'").select("lsn", "op", "logical_id", F.col("src").alias("s"), F.col("dst").alias("d"), "type_id").join(types, "type_id", "left")
    edges = edges.join(ids.select(F.col("vid").alias("s"), F.col("logical").alias("src")), "s", "left").join(ids.select(F.col("vid").alias("d"), F.col("logical").alias("dst")), "d", "left")
    return nodes.unionByName(edges.select("lsn", "op", "logical_id", "edge_type", "src", "dst"), allowMissingColumns=True)


def id_map(pairs: DataFrame, *order: str) -> DataFrame:
    """(logical_id, remote_id) after all ``pairs`` were entered in ``order``: each side names at most one other.

    Entering a pair drops older ones that have either of its ids, so a pair holds if it is the last of
    both. Pairs with a null id are ignored.
    """
    p = pairs.filter("logical_id is not null and remote_id is not null").select("logical_id", "remote_id", F.struct(*order, "logical_id", "remote_id").alias("at"))
    by_logical = p.groupBy("logical_id").agg(F.max_by("remote_id", "at").alias("remote_id"), F.max("at").alias("at"))
    by_remote = p.groupBy("remote_id").agg(F.max_by("logical_id", "at").alias("logical_id"))
    return by_logical.join(by_remote, ["logical_id", "remote_id"], "left_semi").select("logical_id", "remote_id")


class SyncState:
    """Per target: the mark and whether it was seeded, in numbered files of which the newest whole one counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.kept = Numbered(spark, path)

    def read(self) -> dict:
        return self.kept.read() or {}

    def write(self, state: dict) -> None:
        self.kept.write(state)


def sync_once(rows: Callable[[int], DataFrame], state: SyncState, target: str, send: Callable[[DataFrame], None], set_aside: Callable[[DataFrame, str, float], None], batch: int = BATCH) -> int:
    """Ship ``rows(mark)`` in batches of lsn ranges; returns how many batches were acknowledged."""
    all_state = state.read()
    mark = all_state.get(target, {}).get("mark", 0)
    new = rows(mark).filter(F.col("lsn") > mark)
    # one pass over the log: what is new is stored in order of lsn, so that a batch reads its own row groups only
    new = written(new.repartitionByRange("lsn").sortWithinPartitions("lsn"), "sync")
    done = 0
    for head in _heads(new, batch):
        part = new.filter((F.col("lsn") > mark) & (F.col("lsn") <= head))
        try:
            send(part)
        except RemoteError as e:
            set_aside(part, str(e), time.time())
            return done
        mark = head
        all_state[target] = {"mark": mark, "seeded": all_state.get(target, {}).get("seeded", False)}
        state.write(all_state)
        done += 1
    return done


def _heads(new: DataFrame, batch: int) -> Iterator[int]:
    """The last lsn of every batch of about ``batch`` records, ascending, found in one pass over the sorted table.

    Each partition tells where its own batches end; a partition's last one may be smaller.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last, ends = 0, None, []
        for b in batches:
            for x in b.column(0).to_pylist():
                if n >= batch and x != last:
                    ends.append(last)
                    n = 0
                n, last = n + 1, x
        if last is not None:
            ends.append(last)
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64())], ["lsn"])

    for r in new.select(F.col("lsn").cast("long").alias("lsn")).mapInArrow(run, "lsn long").distinct().orderBy("lsn").toLocalIterator():
        yield r.lsn


def seed(export: Callable[[], tuple[DataFrame, DataFrame]], state: SyncState, target: str, send: Callable[[DataFrame], None], lsn: int) -> bool:
    """Send all nodes, then all edges, then set the mark to ``lsn``. A target is seeded once."""
    s = state.read()
    if s.get(target, {}).get("seeded"):
        return False
    if lsn < 0:
        raise DataError("no such lsn")
    for df in export():
        send(df)
    s[target] = {"mark": lsn, "seeded": True}
    state.write(s)
    return True


def tail(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Follow a log stream: each micro-batch goes to ``sink`` with its number, which a repeat has again."""
    q = log.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
