"""Reachability by variable-length edges: walks from all sources at once.

Where every node has at most one successor, walks are doubled: with the node 2, 4, 8, ... steps ahead of
each node, the pairs within k steps give those within 2k by one lookup, so a chain of n steps takes
about log n rounds. Otherwise the walk goes breadth first, a hop a round, from up to 64 starts in one
row: starts are numbered in blocks, and a row (block, node, hops, bits) has a bit for each start of its
block that meets the node at that distance. Where starts meet the same nodes, an edge is then followed
once a block and not once a start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EvalError
from ..session import scratch

SCHEMA = "start long, node long, hops int"
PACKED = "block long, node long, hops int, bits long"
WIDTH = 64  # starts in a block: the bits of a long


def reach(sources: DataFrame, edges: DataFrame, lo: int, hi: int | None, max_hops: int | None = None, symmetric: bool = False) -> DataFrame:
    """(start, node, hops) of every node whose distance from ``start`` lies in [lo, hi]; never start itself.

    ``sources`` has the column start, distinct; ``edges`` (src, dst) are already turned to the walk's
    direction, and ``symmetric`` if every edge is there both ways. A walk without ``hi`` ends when a
    round finds no new pair; with ``max_hops`` it raises if it would go on beyond so many hops. Each
    round's new pairs are written to the shared folder: the plan stays as short as one round, and a
    lost executor costs no more than that.
    """
    found, starts = _found(sources, edges, lo, hi, max_hops, symmetric)
    if starts is None:
        return found
    blocks = starts.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bit", "start"))), lambda x: x["start"]).alias("starts"))
    each = found.join(blocks, "block").select("node", "hops", "bits", F.posexplode("starts").alias("bit", "start"))
    return each.filter("getbit(bits, bit) = 1").select("start", "node", "hops")


def reach_counts(sources: DataFrame, edges: DataFrame, lo: int, hi: int | None, max_hops: int | None = None, symmetric: bool = False, ends: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(start, ``by``, n): how many nodes ``reach`` gives for each start; with ``ends`` (node, ``by``), those of them, by these columns.

    Pairs that are packed are counted so, a sum for each bit, and never become rows.
    """
    found, starts = _found(sources, edges, lo, hi, max_hops, symmetric)
    if ends is not None:
        found = found.join(ends, "node")
    if starts is None:
        return found.groupBy("start", *by).agg(F.count(F.lit(1)).alias("n"))
    sums = [F.count(F.when(F.expr(f"getbit(bits, {i}) = 1"), 1)) for i in range(WIDTH)]
    counts = found.groupBy("block", *by).agg(F.array(*sums).alias("sums"))
    each = counts.select("block", *by, F.posexplode("sums").alias("bit", "n")).filter("n > 0")
    return each.join(starts, ["block", "bit"]).select("start", *by, "n")


def _found(sources: DataFrame, edges: DataFrame, lo: int, hi: int | None, max_hops: int | None, symmetric: bool) -> tuple[DataFrame, DataFrame | None]:
    """The pairs within [lo, hi], and the starts (start, block, bit) if the pairs are packed."""
    spark = sources.sparkSession
    if hi is not None and hi <= 0:
        return sources.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).limit(0), None
    step = edges.select(F.col("src").alias("__at"), F.col("dst").alias("__to")).filter("__at is not null and __to is not null")
    if hi == 1:
        one = sources.join(step, F.col("start") == F.col("__at")).select("start", F.col("__to").alias("node")).filter("start <> node").distinct()
        return one.withColumn("hops", F.lit(1)), None
    path = scratch(spark, "walk")
    step.distinct().write.parquet(f"{path}/edges")
    step = spark.read.schema("__at long, __to long").parquet(f"{path}/edges")
    one_each = (hi is None or hi > 3) and not symmetric and step.groupBy("__at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    starts = None
    if one_each:
        sources.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).write.parquet(f"{path}/0")
        parts = _doubled(path, step, hi, max_hops)
    else:
        # neighbours in the order of ids share a block; ids that are counted up in each partition begin at a multiple of WIDTH there
        sources.sort("start").select("start", F.monotonically_increasing_id().alias("i")).write.parquet(f"{path}/starts")
        starts = spark.read.schema("start long, i long").parquet(f"{path}/starts").selectExpr("start", f"i div {WIDTH} as block", f"cast(i % {WIDTH} as int) as bit")
        starts.selectExpr("block", "start as node", "0 as hops", "shiftleft(1L, bit) as bits").write.parquet(f"{path}/0")
        parts = _hops(path, step, hi, max_hops, symmetric)
    out = spark.read.schema(SCHEMA if one_each else PACKED).parquet(*[f"{path}/{i}" for i in range(parts + 1)])
    return out.filter(F.col("hops").between(max(lo, 1), hi) if hi is not None else F.col("hops") >= max(lo, 1)), starts


def _too_far(max_hops: int) -> EvalError:
    return EvalError(f"the walk goes on beyond {max_hops} hops; give it an upper bound or raise max_hops")


def _hops(path: str, step: DataFrame, hi: int | None, max_hops: int | None, symmetric: bool) -> int:
    """Breadth first; the number of rounds written. Going back and forth, a new pair can only have been met two hops ago."""
    spark = step.sparkSession
    hop = lambda i: spark.read.schema(PACKED).parquet(f"{path}/{i}")
    d = 0
    while hi is None or d < hi:
        if hi is None and max_hops is not None and d >= max_hops:
            raise _too_far(max_hops)
        seen = reduce(DataFrame.union, [hop(i) for i in range(max(0, d - 1) if symmetric else 0, d + 1)])
        new = hop(d).join(step, F.col("node") == F.col("__at")).selectExpr("block", "__to as node", "bits as met", "0L as seen")
        both = new.union(seen.selectExpr("block", "node", "0L as met", "bits as seen")).groupBy("block", "node").agg(F.bit_or("met").alias("met"), F.bit_or("seen").alias("seen"))
        d += 1
        both.selectExpr("block", "node", f"{d} as hops", "met & ~seen as bits").filter("bits <> 0").write.parquet(f"{path}/{d}")
        if hop(d).isEmpty():
            break
    return d


def _doubled(path: str, step: DataFrame, hi: int | None, max_hops: int | None) -> int:
    """Pairs within k steps, moved on by the jump over k; once a pair is met again, all that follows it is, too."""
    spark = step.sparkSession
    pairs = lambda n: spark.read.schema(SCHEMA).parquet(*[f"{path}/{i}" for i in range(n + 1)])
    k, n = 1, 0
    while hi is None or k <= hi:
        met = pairs(n)
        moved = met.join(step, F.col("node") == F.col("__at")).select("start", F.col("__to").alias("node"), (F.col("hops") + k).cast("int").alias("hops"))
        if hi is not None:
            moved = moved.filter(F.col("hops") <= hi)
        new = moved.groupBy("start", "node").agg(F.min("hops").alias("hops")).join(met.select("start", "node"), ["start", "node"], "left_anti")
        n += 1
        new.select("start", "node", "hops").write.parquet(f"{path}/{n}")
        found = spark.read.schema(SCHEMA).parquet(f"{path}/{n}")
        if max_hops is not None and hi is None and not found.filter(F.col("hops") > max_hops).isEmpty():
            raise _too_far(max_hops)
        if found.isEmpty():
            break
        k *= 2
        if hi is None or k <= hi:
            far = step.select(F.col("__at").alias("__mid"), F.col("__to").alias("__end"))
            step.join(far, F.col("__to") == F.col("__mid")).select("__at", F.col("__end").alias("__to")).write.parquet(f"{path}/jump-{k}")
            step = spark.read.schema("__at long, __to long").parquet(f"{path}/jump-{k}")
    return n
