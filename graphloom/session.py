"""Session helpers: where shared files go, and how wide a shuffle should be."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, AQE)."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and the master is local (tests) a temporary
    folder is made; on a cluster an unset folder is an error, since a machine-local one would
    lose data with its executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared root, removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/t"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def package_root() -> str:
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
