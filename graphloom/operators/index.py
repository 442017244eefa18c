"""Secondary indexes: a derived table (value, id), sorted by both, without nulls.

Written sorted by ranges, its row groups have narrow bounds, so a lookup reads few of them. An index
belongs to one version of the graph; ``updated`` derives the next one's from what was touched.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import property_values
from ..model import GraphView, column


class PropertyIndex:
    def __init__(self, entries: DataFrame, path: str | None = None, size: int | None = None) -> None:
        self.entries, self.path, self.size = entries, path, size

    @classmethod
    def build(cls, view: GraphView, key: str, path: str | None = None, labels: tuple[str, ...] = ()) -> PropertyIndex:
        return cls._stored(property_values(view, key, labels).select("value", "vid"), path)

    @classmethod
    def of_table(cls, df: DataFrame, key: str, i: str = "vid", labels: Sequence[str] = (), path: str | None = None) -> PropertyIndex:
        """Of a node or edge table; ``i`` is its id."""
        for x in labels:
            df = df.filter(F.array_contains("labels", x))
        if column(key) not in df.columns:
            return cls(df.select(F.lit(None).cast("string").alias("value"), i).limit(0))
        return cls._stored(df.select(F.col(f"`{column(key)}`").alias("value"), i).filter("value is not null"), path)

    @classmethod
    def _stored(cls, df: DataFrame, path: str | None) -> PropertyIndex:
        if path is None:
            return cls(df)
        i = df.columns[1]
        df.repartitionByRange("value", i).sortWithinPartitions("value", i).write.mode("overwrite").parquet(path)
        kept = df.sparkSession.read.schema(df.schema).parquet(path)
        return cls(kept, path, kept.count())  # from the files' footers

    def updated(self, fresh: PropertyIndex, touched: Sequence[int]) -> PropertyIndex:
        """With the entries of the ``touched`` ids replaced by those of ``fresh``."""
        i = self.entries.columns[1]
        return PropertyIndex(self.entries.filter(~F.col(i).isin(list(touched))).unionByName(fresh.entries.select("value", i)))

    def equal(self, q: Any) -> DataFrame:
        return self.entries.filter(F.col("value") == q).select(self.entries.columns[1])

    def between(self, low: Any, high: Any) -> DataFrame:
        """low <= value < high; of a bool, false lies before true."""
        return self.entries.filter((F.col("value") >= low) & (F.col("value") < high))

    def bounds(self, q: Any) -> DataFrame:
        """(lower, upper, length): positions of the first entry >= q and of the first > q.

        Of a stored index only the row groups with values up to ``q`` are read, since they are sorted.
        """
        if self.size is None:
            return self.entries.agg(F.count_if(F.col("value") < q).alias("lower"), F.count_if(F.col("value") <= q).alias("upper"), F.count(F.lit(1)).alias("length"))
        return self.entries.filter(F.col("value") <= q).agg(F.count_if(F.col("value") < q).alias("lower"), F.count(F.lit(1)).alias("upper"), F.lit(self.size).cast("long").alias("length"))
