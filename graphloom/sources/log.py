"""The change log as a table: committed records, and replay to the last state.

A record may arrive more than once, late and out of order; ``lsn`` identifies it. A record counts
once its transaction has a CommitTxn. Records without ``lsn`` or ``txn_id`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_OPS = ("AddNode", "DelNode", "SetNodeLabels", "SetNodeProp", "DelNodeProp")
EDGE_OPS = ("AddEdge", "DelEdge", "SetEdgeProp", "DelEdgeProp")


def commits(log: DataFrame) -> DataFrame:
    """(txn_id, commit_lsn): one row per committed transaction."""
    return log.filter((F.col("op") == "CommitTxn") & F.col("txn_id").isNotNull()).groupBy("txn_id").agg(F.min(F.coalesce("commit_lsn", "lsn")).alias("commit_lsn"))


def committed(records: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of ``records`` whose transaction committed, with ``commit_lsn``.

    A plain equi-join on ``txn_id``: one row per transaction on the right, so adaptive execution
    can split a transaction that holds very many records.
    """
    drop = [c for c in ("commit_lsn",) if c in records.columns]
    return records.drop(*drop).filter("lsn is not null and txn_id is not null").join(commits(log), "txn_id")


def uncommitted(log: DataFrame) -> DataFrame:
    """The records, one each, of transactions without a CommitTxn."""
    records = log.filter("op not in ('BeginTxn', 'CommitTxn') and lsn is not null and txn_id is not null").dropDuplicates(["lsn"])
    return records.join(commits(log).select("txn_id"), "txn_id", "left_anti")


def since(log: DataFrame, lsn: int) -> DataFrame:
    """The committed records, one each, that recovery from a snapshot at ``lsn`` still has to apply."""
    records = log.filter("op not in ('BeginTxn', 'CommitTxn')").filter(F.col("lsn") > lsn).dropDuplicates(["lsn"])
    return committed(records, log)


def last_writes(log: DataFrame, owner: str = "edge") -> DataFrame:
    """(id, key_id, prop_value, lsn): the last committed value set of each property; ``id`` is eid or vid.

    The newest is chosen by ``lsn``, combined where the rows lie; properties deleted later have a null.
    """
    i, kind = ("eid", "Edge") if owner == "edge" else ("vid", "Node")
    rec = committed(log.filter(F.col("op").isin(f"Set{kind}Prop", f"Del{kind}Prop")).select("lsn", "txn_id", "op", i, "key_id", "prop_value"), log)
    value = F.when(F.col("op") == f"Set{kind}Prop", F.col("prop_value"))
    return rec.groupBy(i, "key_id").agg(F.max_by(F.struct(value.alias("v")), "lsn").alias("x"), F.max("lsn").alias("lsn")).select(i, "key_id", F.col("x.v").alias("prop_value"), "lsn")


def packed(alive: Column | bool) -> Column:
    """``lsn`` and one bit in a long, so that the newest wins a plain maximum."""
    bit = F.lit(int(alive)) if isinstance(alive, bool) else alive.cast("long")
    return F.col("lsn") * 2 + bit


def node_lives(records: DataFrame) -> DataFrame:
    """(vid, since): nodes that exist after the committed node ``records``, and the lsn of their AddNode.

    An AddNode for a node that is there replaces it.
    """
    ends = records.filter(F.col("op").isin("AddNode", "DelNode") & F.col("vid").isNotNull())
    last = ends.groupBy("vid").agg(F.max(packed(F.col("op") == "AddNode")).alias("x"))
    return last.filter("x % 2 = 1").select("vid", F.expr("x div 2").alias("since"))
