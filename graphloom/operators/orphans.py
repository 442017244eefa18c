"""References to records that do not exist, per table and period.

References and parent keys are brought to one binary key, co-partitioned and sorted by it, and both
streams are merged linearly; a parent's validity interval tells missing, deleted and late apart.
The few keys that hold a large share of the references are merged with their parents where they
lie, so no task gets all references of a heavy key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import HEAVY, heavy_keys


def reference_key(ref: Column) -> Column:
    """A UUID in any spelling (case, hyphens, braces, ``urn:uuid:``, white space) gives the same key; other text stands for itself."""
    bare = F.replace(F.translate(F.lower(ref), "-{}() \t\r\n\v\f\u00a0", ""), F.lit("urn:uuid:"), F.lit(""))
    uuid = F.when((F.length(bare) == 32) & bare.rlike("^[0-9a-f]{32}$"), F.concat(F.encode(F.lit("u"), "UTF-8"), F.unhex(bare)))
    return F.coalesce(uuid, F.concat(F.encode(F.lit("r"), "UTF-8"), F.encode(ref, "UTF-8")))


def node_names(logical_id: Column, vid: Column) -> Column:
    """The keys a node can be named by, exploded: its id and ``local-<vid>``; null where it lacks one."""
    return F.explode(F.array(reference_key(logical_id), reference_key(F.concat(F.lit("local-"), vid.cast("string")))))


def parent_intervals(nodes: DataFrame) -> DataFrame:
    """(key, deleted_at, loaded_at), one row per key a node can be named by: its id and ``local-<vid>``.

    A node may have several rows: its first load and its first deletion count. Rows without an id are
    named by ``vid`` alone, and the other way round.
    """
    one = nodes.groupBy("logical_id", "vid").agg(F.min("deleted_at").alias("deleted_at"), F.min("loaded_at").alias("loaded_at"))
    named = one.select(node_names(F.col("logical_id"), F.col("vid")).alias("key"), "deleted_at", "loaded_at")
    return named.filter("key is not null").groupBy("key").agg(F.min("deleted_at").alias("deleted_at"), F.min("loaded_at").alias("loaded_at"))


def merge(refs: DataFrame, parents: DataFrame, counts: DataFrame, total: int, share: float = HEAVY) -> DataFrame:
    """``refs`` (with ``key``) left-merged with ``parents`` (``key`` unique), spread even if a key is heavy.

    ``counts`` (key, n) tells how often each key is referred to, ``total`` how many references there are. Heavy keys are at most 1 / share, so
    what is broadcast is bounded whatever the tables' size.
    """
    hot = heavy_keys(counts, total, share)
    p = parents.withColumn("is_there", F.lit(True))
    if not hot:
        return refs.join(p.hint("merge"), "key", "left")
    marks = F.broadcast(refs.sparkSession.createDataFrame([(bytearray(k),) for k in hot], "key binary"))
    parents_of_hot = F.broadcast(marks.join(p.join(marks, "key", "left_semi"), "key", "left"))
    light = refs.join(marks, "key", "left_anti").join(p.hint("merge"), "key", "left")
    return light.unionByName(refs.join(parents_of_hot, "key"))


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_logical_id, edge_end, reason, period_ym): ends of ``edges`` that name no node, a deleted or a later one.

    ``reason`` is the first that holds: ``missing``; ``deleted``, at or before the edge's creation;
    ``late``, first loaded after the edge was. Null ends are no references. An edge without
    ``created_at`` is never ``deleted`` and has a null period. Repeated edges are reported once.
    """
    return _orphans(edges, nodes).select("edge_logical_id", "edge_end", "reason", "period_ym")


def _orphans(edges: DataFrame, nodes: DataFrame, *kept: str) -> DataFrame:
    """The orphans with columns of the edge that travel along."""
    e = edges.groupBy("logical_id", "src_logical_id", "dst_logical_id", "created_at").agg(F.min("loaded_at").alias("edge_loaded"), *[F.min(c).alias(c) for c in kept])
    ends = F.explode(F.array(F.struct(F.lit("src").alias("edge_end"), F.col("src_logical_id").alias("ref")), F.struct(F.lit("dst").alias("edge_end"), F.col("dst_logical_id").alias("ref"))))
    refs = e.select("logical_id", "created_at", "edge_loaded", *kept, ends.alias("x")).filter("x.ref is not null")
    refs = refs.select("logical_id", "created_at", "edge_loaded", *kept, "x.edge_end", reference_key(F.col("x.ref")).alias("key"))
    # counted as stored, where the rows lie, before spellings are brought together
    stored = edges.select(F.explode(F.array("src_logical_id", "dst_logical_id")).alias("ref")).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    m = merge(refs, parent_intervals(nodes), stored.filter("ref is not null").select(reference_key(F.col("ref")).alias("key"), "n"), 2 * edges.count())
    reason = F.when(F.col("is_there").isNull(), "missing").when(F.col("deleted_at") <= F.col("created_at"), "deleted").when(F.col("loaded_at") > F.col("edge_loaded"), "late")
    out = m.withColumn("reason", reason).filter("reason is not null")
    return out.select(F.col("logical_id").alias("edge_logical_id"), "edge_end", "reason", F.date_format("created_at", "yyyy-MM").alias("period_ym"), *kept)


def orphan_report(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_type, edge_end, reason, period_ym, n): orphans per table (edge type) and month."""
    return _orphans(edges, nodes, "edge_type").groupBy("edge_type", "edge_end", "reason", "period_ym").agg(F.count(F.lit(1)).alias("n"))
