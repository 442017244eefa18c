"""Synthetic graphs and ids."""

from __future__ import annotations

import os
import threading
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rmat(spark: SparkSession, scale: int, edges: int, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """(eid, src, dst): ``edges`` R-MAT edges over 2**scale nodes; each bit picks a quadrant.

    The draw is a hash of edge, bit and seed, so the same graph comes out on any cluster.
    """

    def draw(bit: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64("id", F.lit(bit), F.lit(seed)), 11) / float(1 << 53)

    src, dst = [], []
    for bit in range(scale):
        u = draw(bit)
        src.append(F.when(u >= a + b, 1 << bit).otherwise(0).cast("long"))
        dst.append(F.when(((u >= a) & (u < a + b)) | (u >= a + b + c), 1 << bit).otherwise(0).cast("long"))
    add = lambda xs: reduce(lambda x, y: x + y, xs, F.lit(0).cast("long"))
    return spark.range(edges).select(F.col("id").alias("eid"), add(src).alias("src"), add(dst).alias("dst"))


def quadrants(edges: DataFrame, scale: int) -> DataFrame:
    """(bit, quadrant, n): how many edges fall in each quadrant (a, b, c, d) at each bit of their ends."""
    pick = lambda k: F.struct(F.lit(k).alias("bit"), F.element_at(F.array(*map(F.lit, "abcd")), (F.shiftright("src", k) % 2 * 2 + F.shiftright("dst", k) % 2 + 1).cast("int")).alias("quadrant"))
    return edges.select(F.explode(F.array(*[pick(k) for k in range(scale)])).alias("x")).groupBy("x.bit", "x.quadrant").agg(F.count(F.lit(1)).alias("n"))


def uuid7(now_ms: int | None = None) -> str:
    """A time-ordered UUID."""
    t = int(time.time() * 1000) if now_ms is None else now_ms
    r = int.from_bytes(os.urandom(10), "big")
    x = (t & ((1 << 48) - 1)) << 80 | 7 << 76 | (r >> 68 & 0xFFF) << 64 | 2 << 62 | r & ((1 << 62) - 1)
    h = f"{x:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


@dataclass(order=True, frozen=True)
class Stamp:
    wall: int
    count: int
    node: str


class HybridClock:
    """Timestamps that follow the wall clock and never go back, also across machines that exchange them."""

    def __init__(self, node: str, wall=lambda: int(time.time() * 1000)) -> None:  # noqa: ANN001
        self.node, self.wall, self.last, self.lock = node, wall, Stamp(0, 0, node), threading.Lock()

    def tick(self, seen: Stamp | None = None) -> Stamp:
        with self.lock:
            top = max(self.wall(), self.last.wall, seen.wall if seen else 0)
            counts = [s.count for s in (self.last, seen) if s and s.wall == top]
            self.last = Stamp(top, max(counts) + 1 if counts else 0, self.node)
            return self.last
