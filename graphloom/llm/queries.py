"""Queries of the text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .leakage import leaked_items, leaks
from .lookalike import lookalike_classes, lookalike_pairs
from .tokenize import encode_corpus


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p6_ids": lambda s, d: encode_corpus(_table(s, d, "documents")),
        "p7_found": lambda s, d: leaked_items(_table(s, d, "documents"), _table(s, d, "eval_items")),
        "p7_alignments": lambda s, d: leaks(_table(s, d, "documents"), _table(s, d, "eval_items")),
        "p8_found": lambda s, d: lookalike_pairs(_table(s, d, "documents")),
        "p8_classes": lambda s, d: lookalike_classes(_table(s, d, "documents")),
    }
