"""Apply a change feed of inserts, updates and deletes as a stream.

Two streaming steps. ``gate`` holds records back until the commit of their transaction has arrived,
in whatever order both arrive. ``upserts`` keeps, per entity and slot (existence, or one of its
attributes), the last sequence number, the payload and whether it is a tombstone; a change is
accepted only if it is newer, so repeated and out-of-order changes don't matter. Every micro-batch
writes what changed under its own number and replaces that when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove
from ..sources.log import NODE_OPS

#: Slots below the labels, which are not negative.
LIFE, TOUCH = -1, -2
RECORD = T.StructType([T.StructField(n, t) for n, t in (("lsn", T.LongType()), ("txn_id", T.LongType()), ("op", T.StringType()), ("vid", T.LongType()), ("logical_id", T.StringType()), ("label_ids", T.ArrayType(T.IntegerType())), ("added", T.ArrayType(T.IntegerType())), ("removed", T.ArrayType(T.IntegerType())))])
STATE = "vid long, slot int, seq long, alive boolean, payload string"
#: Batches between compactions of what the gate holds and of the state that is read.
COMPACT = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The log's folder (or file) as a stream; its schema is read from the files, not guessed."""
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    return r.parquet(path if folder else f"{path[:-1]}[{path[-1]}]")  # a stream takes a single file only as a pattern


def gate(log: DataFrame, out: str, compact: int = COMPACT) -> None:
    """Run the stream over what is there: node records to ``out/gated/batch=<n>/ok=<committed>``.

    A batch lets through its own records whose commit is known and earlier ones whose commit it brings.
    What is held back stays where it was written; every ``compact`` batches, held records and known
    commits are brought into new tables sorted by transaction (``base=<n>``), without those let through
    since. A batch reads of these tables only the stretches its transactions lie in, so its cost
    follows its own size, not the stream's age. Paths follow from the batch alone and a batch reads
    only earlier ones, so a repeated batch gives the same files. A record let through twice, because
    its commit was delivered twice, does no harm: its state is newer already.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        base = n - n % compact
        if n and n == base:
            _compact(spark, out, n, compact)
        new = batch.filter("op = 'CommitTxn' and txn_id is not null").select("txn_id").distinct()
        records = batch.filter(F.col("op").isin(*NODE_OPS) & F.col("vid").isNotNull() & F.col("lsn").isNotNull()).select(*RECORD.names)
        new.write.mode("overwrite").parquet(f"{out}/commits/batch={n}")
        new = known = spark.read.schema("txn_id long").parquet(f"{out}/commits/batch={n}")
        freed = None
        if n:
            known = known.unionByName(_known(spark, out, base, n).filter(_near(records))).distinct()
            freed = _held(spark, out, base, n).filter(_near(new)).join(new, "txn_id", "left_semi")
        gated = records.join(known.withColumn("ok", F.lit(True)), "txn_id", "left").withColumn("ok", F.col("ok").isNotNull())
        if freed is not None:
            gated = gated.unionByName(freed.withColumn("ok", F.lit(True)))
        gated.write.mode("overwrite").partitionBy("ok").parquet(f"{out}/gated/batch={n}")

    _run(log.writeStream.foreachBatch(step), f"{out}/checkpoint-gate")


def _known(spark: SparkSession, out: str, base: int, n: int) -> DataFrame:
    """Transactions committed before batch ``n``."""
    return spark.read.schema("txn_id long").parquet(*([f"{out}/commits/base={base}"] if base else []), *[f"{out}/commits/batch={i}" for i in range(base, n)], *([] if base or n else [f"{out}/commits/none"]))


def _held(spark: SparkSession, out: str, base: int, n: int) -> DataFrame:
    """Records held back before batch ``n``, some of them let through since."""
    paths = ([f"{out}/held/base={base}"] if base else []) + [p for i in range(base, n) if _exists(spark, p := f"{out}/gated/batch={i}/ok=false")]
    return spark.read.schema(RECORD).parquet(*paths) if paths else spark.createDataFrame([], RECORD)


def _compact(spark: SparkSession, out: str, n: int, compact: int) -> None:
    """Tables of what is known and held before batch ``n``; those of two compactions ago are not needed any more."""
    sort = lambda df: df.repartitionByRange("txn_id").sortWithinPartitions("txn_id")
    sort(_known(spark, out, n - compact, n).distinct()).write.mode("overwrite").parquet(f"{out}/commits/base={n}")
    done = spark.read.schema("txn_id long").parquet(f"{out}/commits/base={n}")
    sort(_held(spark, out, n - compact, n).join(done, "txn_id", "left_anti")).write.mode("overwrite").parquet(f"{out}/held/base={n}")
    old = n - 2 * compact
    if old >= 0:
        for p in [f"{out}/commits/base={old}", f"{out}/held/base={old}", *[f"{out}/commits/batch={i}" for i in range(old, n - compact)]]:
            remove(spark, p)


def _near(df: DataFrame, stretches: int = 64) -> Column:
    """A filter on ``txn_id`` that the ids of ``df`` pass, as at most so many ranges, which prune a sorted table."""
    lo, hi = df.agg(F.min("txn_id"), F.max("txn_id")).first()
    if lo is None:
        return F.lit(False)
    width = (hi - lo) // stretches + 1
    spans = df.groupBy(F.floor((F.col("txn_id") - lo) / width)).agg(F.min("txn_id").alias("a"), F.max("txn_id").alias("b")).collect()
    out = F.lit(False)
    for r in spans:
        out = out | F.col("txn_id").between(r.a, r.b)
    return out


def _run(writer, checkpoint: str) -> None:  # noqa: ANN001
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def node_changes(records: DataFrame) -> DataFrame:
    """(vid, slot, seq, alive, payload) of node records: existence, last touch, and each label set or taken away."""
    change = lambda slot, alive, payload=None: F.struct(slot.cast("int").alias("slot"), F.lit(alive).alias("alive"), (payload if payload is not None else F.lit(None).cast("string")).alias("payload"))
    none = F.array().cast("array<int>")
    added = F.when(F.col("op") == "AddNode", F.coalesce("label_ids", none)).when(F.col("op") == "SetNodeLabels", F.coalesce("added", none)).otherwise(none)
    removed = F.when(F.col("op") == "SetNodeLabels", F.array_except(F.coalesce("removed", none), F.coalesce("added", none))).otherwise(none)
    life = F.when(F.col("op") == "AddNode", F.array(change(F.lit(LIFE), True, F.col("logical_id")))).when(F.col("op") == "DelNode", F.array(change(F.lit(LIFE), False))).otherwise(F.array(change(F.lit(TOUCH), True)))
    every = F.concat(life, F.transform(F.array_distinct(F.filter(added, lambda x: x.isNotNull())), lambda x: change(x, True)), F.transform(F.filter(removed, lambda x: x.isNotNull()), lambda x: change(x, False)))
    return records.select("vid", "lsn", F.explode(every).alias("c")).select("vid", "c.slot", F.col("lsn").alias("seq"), "c.alive", "c.payload")


def upserts(changes: DataFrame, keys: list[str], out: str) -> None:
    """Keyed state over a stream of changes (``keys``, seq, alive, payload), upserts to ``out/state/batch=<n>``."""
    last = F.max(F.struct("seq", "alive", "payload")).alias("last")
    spark = changes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def step(batch: DataFrame, n: int) -> None:
        batch.select(*keys, "last.*").write.mode("overwrite").parquet(f"{out}/state/batch={n}")

    try:
        _run(changes.groupBy(*keys).agg(last).writeStream.outputMode("update").foreachBatch(step), f"{out}/checkpoint-state")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``batch=<n>`` in ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName()[6:]) for x in fs.listStatus(p) if x.getPath().getName().startswith("batch=")) if fs.exists(p) else []


def _versions(spark: SparkSession, out: str) -> tuple[int, list[str]]:
    """(n, folders): the newest whole base, which holds the batches before ``n``, and the batches from ``n`` on."""
    bases = [n for n in _batches(spark, f"{out}/base") if _exists(spark, f"{out}/base/batch={n}/_SUCCESS")]
    n = max(bases, default=0)
    return n, ([f"{out}/base/batch={n}"] if n else []) + [f"{out}/state/batch={i}" for i in _batches(spark, f"{out}/state") if i >= n]


def current(spark: SparkSession, keys: list[str], schema: str, out: str) -> DataFrame:
    """The newest upsert of every key, tombstones included: of the base version and the batches since."""
    paths = _versions(spark, out)[1]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.groupBy(*keys).agg(F.max(F.struct("seq", "alive", "payload")).alias("x")).select(*keys, "x.*")


def fold(spark: SparkSession, keys: list[str], schema: str, out: str, compact: int = COMPACT) -> None:
    """After ``compact`` batches, write a base version that holds them; the batches and bases it replaces go one fold later."""
    n, paths = _versions(spark, out)
    batches = [i for i in _batches(spark, f"{out}/state") if i >= n]
    if len(batches) < compact:
        return
    top = batches[-1] + 1
    current(spark, keys, schema, out).write.mode("overwrite").parquet(f"{out}/base/batch={top}")
    for i in _batches(spark, f"{out}/state"):
        if i < n:
            remove(spark, f"{out}/state/batch={i}")
    for i in _batches(spark, f"{out}/base"):
        if i < n:
            remove(spark, f"{out}/base/batch={i}")


def apply_node_feed(spark: SparkSession, path: str, out: str, files_per_batch: int | None = None, compact: int = COMPACT) -> DataFrame:
    """Bring ``out`` up to date with the log at ``path`` and return its nodes: (vid, logical_id, label_list, last_lsn).

    Can be called again when the log has grown: only new files are read. Only records of committed
    transactions take effect, once each, in order of lsn; an AddNode replaces a node that is there,
    other records about a node that is not there have no effect. A node without labels has an empty
    list. Records without vid, lsn or transaction are ignored; an empty log gives no node.
    """
    gate(log_stream(spark, path, files_per_batch), out, compact)
    if _exists(spark, f"{out}/gated/batch=*/ok=true"):
        through = spark.readStream.schema(RECORD).parquet(f"{out}/gated/batch=*/ok=true")
        upserts(node_changes(through), ["vid", "slot"], out)
        fold(spark, ["vid", "slot"], STATE, out, compact)
    return nodes(spark, out)


def nodes(spark: SparkSession, out: str) -> DataFrame:
    s = current(spark, ["vid", "slot"], STATE, out)
    label = F.when((F.col("slot") >= 0) & F.col("alive"), F.struct("slot", "seq"))
    n = s.groupBy("vid").agg(
        F.max(F.when(F.col("slot") == LIFE, F.struct("seq", "alive", "payload"))).alias("life"),
        F.max("seq").alias("last_lsn"),
        F.collect_list(label).alias("labels"),
    )
    kept = F.array_sort(F.transform(F.filter("labels", lambda x: x["seq"] >= F.col("life.seq")), lambda x: x["slot"]))
    return n.filter("life.alive").select("vid", F.col("life.payload").alias("logical_id"), F.array_join(kept.cast("array<string>"), ",").alias("label_list"), "last_lsn")
