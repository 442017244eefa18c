"""Violations of constraints, as queries over a node table (vid, labels, null_keys, p_<key>)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import column


def _of(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.array_contains("labels", label)) if label else nodes


def unique_violations(nodes: DataFrame, label: str, key: str) -> DataFrame:
    """(value, n): values that several nodes of the label have; nulls don't count. An empty label means all nodes."""
    if column(key) not in nodes.columns:
        return nodes.sparkSession.createDataFrame([], "value string, n long")
    v = F.col(f"`{column(key)}`")
    return _of(nodes, label).filter(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def existence_violations(nodes: DataFrame, label: str, key: str, i: str = "vid") -> DataFrame:
    """(vid): nodes of the label on which the key is not set; an explicit null counts as set. Edges have ``i`` eid."""
    of = _of(nodes, label)
    if column(key) not in nodes.columns:
        return of.select(i)
    null = F.array_contains(F.coalesce("null_keys", F.array().cast("array<string>")), key) if "null_keys" in nodes.columns else F.lit(False)
    return of.filter(F.col(f"`{column(key)}`").isNull() & ~null).select(i)
