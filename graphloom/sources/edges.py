"""Edges of the change log after replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import committed, node_lives, packed


def replay_edges(log: DataFrame) -> DataFrame:
    """(eid, src, dst, type_id, since): edges that exist at the end of the log.

    An edge exists if it was added by a committed record while both ends were there, and neither it
    nor an end was deleted since. An AddEdge for an edge that is there replaces it.
    """
    cols = ("lsn", "txn_id", "op", "vid", "eid", "src", "dst", "type_id")
    nodes = node_lives(committed(log.filter("op in ('AddNode', 'DelNode')").select("lsn", "txn_id", "op", "vid"), log))
    rec = committed(log.filter("op in ('AddEdge', 'DelEdge') and eid is not null").select(*cols), log)
    last = rec.groupBy("eid").agg(F.max(packed(F.col("op") == "AddEdge")).alias("x"), F.max_by(F.when(F.col("op") == "AddEdge", F.struct("src", "dst", "type_id")), F.when(F.col("op") == "AddEdge", F.col("lsn"))).alias("e"))
    alive = last.filter("x % 2 = 1").select("eid", "e.src", "e.dst", "e.type_id", F.expr("x div 2").alias("since"))
    for end in ("src", "dst"):
        n = nodes.select(F.col("vid").alias(end), F.col("since").alias("born"))
        alive = alive.join(n, end).filter("born < since").drop("born")
    return alive.select("eid", "src", "dst", "type_id", "since")
