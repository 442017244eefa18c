"""Per-key results where a few keys hold most rows.

``frequencies`` groups by key and value before key: however many rows a key has, what is shuffled
is one row per distinct value, already combined where the rows lie, and its hash spreads a key over
all tasks. Counts, exact distinct counts, modes and percentiles follow from the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: A key is heavy if it has more than this share of the rows, so there are at most 1 / HEAVY of them.
HEAVY = 1 / 2000


def frequencies(rows: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """(key, value, n): value-frequency compression. Null keys are dropped, null values kept."""
    k, v = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    return rows.select(k.alias("key"), v.alias("value")).filter("key is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def summary(freq: DataFrame) -> DataFrame:
    """(key, n, n_distinct, mode): of non-null values; the least of several modes. All-null keys have no mode.

    One aggregate, combined where the rows lie: no key's values come together in a task.
    """
    some = F.col("value").isNotNull()
    best = F.min(F.when(some, F.struct((-F.col("n")).alias("n"), F.col("value").alias("value"))))
    out = freq.groupBy("key").agg(F.sum(F.when(some, F.col("n")).otherwise(0)).alias("n"), F.count("value").alias("n_distinct"), best.alias("best"))
    return out.select("key", "n", "n_distinct", F.col("best.value").alias("mode"))


def percentiles(freq: DataFrame, ps: list[float], strips: int = 256) -> DataFrame:
    """(key, p, value): exact discrete percentiles of numeric values from their frequencies.

    The value at rank ceil(p * n), 1 at least. A key's values are first summed in ``strips`` strips
    between its least and greatest value, then only the strip that holds a rank is sorted, in turn
    with strips of its own if it is still wide: no task sees all values of a heavy key. Values of keys
    with a large share of them meet their ranks where they lie, those of other keys after a shuffle.
    Keys without a non-null value give no row.
    """
    f = freq.filter("value is not null").select("key", F.col("value").cast("double").alias("v"), "value", "n")
    span = written(f.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")), "span")
    hot = heavy_keys(span.select("key", F.col("m").alias("n")), span.agg(F.sum("m")).first()[0] or 0)
    marks = f.sparkSession.createDataFrame([(k,) for k in hot], f"key {dict(f.dtypes)['key']}") if hot else None

    def meet(want: DataFrame) -> DataFrame:
        if marks is None:
            return f.join(want, "key")
        few = F.broadcast(want.join(F.broadcast(marks), "key", "left_semi"))  # at most 2000 keys, a row for each of ps
        return f.join(F.broadcast(marks), "key", "left_anti").join(want, "key").unionByName(f.join(few, "key"))

    want = span.drop("m").withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(ps))]))).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("total")), F.lit(1))).drop("total")
    for _ in range(2):
        width = (F.col("hi") - F.col("lo")) / strips
        strip = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(strips - 1))).otherwise(0)
        inside = meet(want).filter("v >= lo and v <= hi").withColumn("strip", strip)
        sums = inside.groupBy("key", "p", "rank", "strip").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy("key", "p").orderBy("strip")
        cum = sums.withColumn("upto", F.sum("n").over(w))
        want = cum.filter("upto >= rank and upto - n < rank").select("key", "p", "lo", "hi", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    inside = meet(want).filter("v >= lo and v <= hi")
    w = Window.partitionBy("key", "p").orderBy("v", "value")
    return inside.withColumn("upto", F.sum("n").over(w)).filter("upto >= rank and upto - n < rank").select("key", "p", "value")


def heavy_keys(counts: DataFrame, total: int, share: float = HEAVY) -> list:
    """Keys with more than ``share`` of all ``total`` rows, from exact ``counts`` (key, n): at most 1 / share of them."""
    rows = counts.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > total * share)
    return [r.key for r in rows.select("key").collect()]


def pack(c: Column) -> Column:
    """A text as bytes, a UUID in its usual spelling as 17 of them; ``unpack`` gives the text back."""
    usual = c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\\z")
    tag = lambda t: F.encode(F.lit(t), "UTF-8")
    return F.when(usual, F.concat(tag("u"), F.unhex(F.translate(c, "-", "")))).otherwise(F.concat(tag("t"), F.encode(c, "UTF-8")))


def unpack(b: Column) -> Column:
    h = F.lower(F.hex(b))
    usual = F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((3, 8), (11, 4), (15, 4), (19, 4), (23, 12))])
    return F.when(h.startswith("75"), usual).when(b.isNotNull(), F.decode(F.substring(b, F.lit(2), F.length(b)), "UTF-8"))


def edge_profile(edges: DataFrame, edge_id: str = "logical_id", src: str = "src_logical_id", dst: str = "dst_logical_id") -> DataFrame:
    """(edge_end, node_ref, n_edges, n_peers) for every non-null end value, as stored.

    ``n_edges`` counts distinct edge ids, ``n_peers`` distinct non-null values at the other end.
    Repeated rows count once. A null edge id is one id like any other value. Node references that
    occur only at null ends have no row.

    Distinct edges are reduced to (src, dst, number of edges) first, from which both ends follow.
    An id stored with several pairs of ends would then count once for each; what it counts too
    often is taken off again, from the rows of such ids alone. Whether there are any is found from
    hashes of the ids, so the edges are shuffled again only if there are.
    """
    # written once: pairs, hashes and suspects all read it
    e = written(edges.select(*[pack(F.col(c).cast("string")).alias(n) for c, n in ((edge_id, "id"), (src, "src"), (dst, "dst"))]).distinct(), "edges")
    pairs = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    hashes = e.groupBy(F.xxhash64("id").alias("h")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    suspects = e.withColumn("h", F.xxhash64("id")).filter(hashes.agg(F.count(F.lit(1))).scalar() > 0).join(hashes, "h", "left_semi")
    several = suspects.groupBy("id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("id")
    odd = suspects.join(several, suspects["id"].eqNullSafe(several["id"]), "left_semi")

    def end(name: str, a: str, b: str) -> DataFrame:
        base = pairs.filter(F.col(a).isNotNull()).groupBy(F.col(a).alias("ref")).agg(F.sum("n").alias("n"), F.count(b).alias("n_peers"))
        extra = odd.filter(F.col(a).isNotNull()).groupBy(a, "id").agg((F.count(F.lit(1)) - 1).alias("x")).filter("x > 0").groupBy(F.col(a).alias("ref")).agg((-F.sum("x")).alias("n"), F.lit(0).cast("long").alias("n_peers"))
        return base.unionByName(extra).withColumn("edge_end", F.lit(name))

    both = end("src", "src", "dst").unionByName(end("dst", "dst", "src"))
    return both.groupBy("edge_end", "ref").agg(F.sum("n").alias("n_edges"), F.sum("n_peers").alias("n_peers")).select("edge_end", unpack(F.col("ref")).alias("node_ref"), "n_edges", "n_peers")
