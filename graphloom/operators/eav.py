"""Attribute-value rows into wide, typed tables.

The last value of every (entity, attribute) is written to one narrow table per attribute, in its
declared type, all bucketed by entity alike. The wide table is put together from the narrow ones by
outer joins of several tables at a time, combined in a balanced tree; as every step is keyed and
bucketed by entity, no join shuffles anything. Buckets are as many as the data asks for. The wide table
is stored, then the narrow ones are dropped and the session's settings are as they were.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch, written
from ..sources.log import committed, node_lives

TYPES = {"int": "bigint", "double": "double", "bool": "boolean", "string": "string"}
#: Narrow tables joined at once at a leaf of the tree; each leaf reads the spine of entities once.
FAN_IN = 8
#: Bytes of source for a bucket.
BUCKET_BYTES = 128 << 20
_OPTION = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


@dataclass(frozen=True)
class Attribute:
    key_id: int
    name: str
    type: str

    @property
    def column(self) -> str:
        """Unique even if two attributes have the same name."""
        return f"k{self.key_id}"


def attributes(keys: DataFrame, owner: str = "node") -> list[Attribute]:
    """The declared attributes; the declaration is the wide table's schema, so it fits on the driver."""
    rows = keys.filter((F.col("owner_kind") == owner) & F.col("key_id").isNotNull() & F.col("value_type").isin(*TYPES)).select("key_id", "key_name", "value_type").distinct().orderBy("key_id", "value_type").collect()
    return list({r.key_id: Attribute(r.key_id, r.key_name, r.value_type) for r in reversed(rows)}.values())[::-1]


def scalar(value: Column) -> Column:
    """One JSON value as text -> struct(kind, raw): 'n'umber or 'b'ool as written, 's'tring's content, else null."""
    v = F.regexp_replace(value, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    plain = F.substring(v, F.lit(2), F.length(v) - 2)
    parsed = F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>")
    text = F.when(v.rlike(r'^"[^"\\\x00-\x1f]*"$'), plain).when(F.size(parsed) == 1, parsed[0])
    kind = F.when(v.startswith('"'), F.when(text.isNotNull(), "s")).when(v.isin("true", "false"), "b").when(v.rlike(_JSON_NUMBER), "n")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "s", text).otherwise(v).alias("raw")))


class _Raw(str):
    """A number as it is written."""


def _objects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vid, lsn, props) -> one row per attribute. Numbers keep their spelling, which no built-in function does."""
    decode = json.JSONDecoder(parse_float=_Raw, parse_int=_Raw, parse_constant=lambda _: None).decode
    schema = pa.schema([("vid", pa.int64()), ("lsn", pa.int64()), ("key_id", pa.int32()), ("kind", pa.string()), ("raw", pa.string())])
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for vid, lsn, props in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            try:
                o = decode(props)
            except ValueError:
                continue
            for k, v in o.items() if isinstance(o, dict) else ():
                if not (k.isascii() and k.isdigit() and len(k) < 10 and str(int(k)) == k):
                    continue
                kind, raw = ("n", str(v)) if type(v) is _Raw else ("s", v) if type(v) is str else ("b", "true" if v else "false") if type(v) is bool else (None, None)
                if kind == "s" and not raw.isascii():
                    raw = raw.encode("utf-8", "replace").decode()  # half of a surrogate pair
                for col, x in zip(out, (vid, lsn, int(k), kind, raw), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def node_attributes(log: DataFrame) -> DataFrame:
    """(vid, lsn, key_id, kind, raw) set or taken away by committed records; kind is null where no value is left."""
    cols = ("lsn", "txn_id", "op", "vid", "key_id", "prop_value", "props")
    rec = committed(log.filter("op in ('AddNode', 'SetNodeProp', 'DelNodeProp') and vid is not null").select(*cols).filter("op <> 'AddNode' or props is not null"), log)
    single = rec.filter("op <> 'AddNode' and key_id is not null").withColumn("v", F.when(F.col("op") == "SetNodeProp", scalar(F.col("prop_value"))))
    whole = rec.filter("op = 'AddNode'").select("vid", "lsn", "props").mapInArrow(_objects, "vid long, lsn long, key_id int, kind string, raw string")
    return single.select("vid", "lsn", "key_id", "v.kind", "v.raw").unionByName(whole)


def last_values(rows: DataFrame, entity: str = "vid") -> DataFrame:
    """The newest row of each (entity, attribute), combined where the rows lie before they are shuffled."""
    return rows.groupBy(entity, "key_id").agg(F.max(F.struct("lsn", "kind", "raw")).alias("x")).select(entity, "key_id", "x.*")


def typed(kind: Column, raw: Column, value_type: Column) -> dict[str, Column]:
    """The value read in its declared type, one column per type; null where it cannot be read."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    number = F.when(kind.isin("n", "s") & text.rlike(_NUMBER), text)
    dec, dbl = number.try_cast("decimal(38,18)"), number.try_cast("double")
    whole = F.when((dec == F.floor(dec)) & ((dec != 0) | (dbl == 0)), dec.try_cast("bigint"))
    finite = F.when(F.abs(dbl) < float("inf"), dbl)
    yes = F.lower(text)
    flag = F.when(kind.isin("b", "s") & yes.isin("true", "false"), yes == "true")
    is_ = lambda t: value_type == t
    return {"int": F.when(is_("int"), whole), "double": F.when(is_("double"), finite), "bool": F.when(is_("bool"), flag), "string": F.when(is_("string") & kind.isNotNull(), raw)}


def bucket_count(source: DataFrame) -> int:
    """Buckets for what comes of ``source``: one for each ``BUCKET_BYTES`` of the tables it reads, at least the session's shuffle partitions.

    Tables whose size Spark doesn't know count nothing.
    """
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)
    return min(max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)), 100_000)


class NarrowTables:
    """One table per attribute, each bucketed and sorted by entity; a context that drops them in the end."""

    def __init__(self, values: DataFrame, spine: DataFrame, attrs: Sequence[Attribute], entity: str = "vid", buckets: int | None = None) -> None:
        self.spark, self.attrs, self.entity = values.sparkSession, list(attrs), entity
        self.buckets = buckets or bucket_count(values)
        self.path = scratch(self.spark, "narrow")
        self.name = "narrow_" + self.path.rsplit("-", 1)[1]
        types = {a.key_id: a.type for a in self.attrs}
        declared = F.create_map(*[F.lit(x) for kv in types.items() for x in kv]) if types else F.create_map().cast("map<int,string>")
        v = values.withColumn("value_type", declared[F.col("key_id")]).filter("value_type is not null and kind is not null")
        cols = typed(F.col("kind"), F.col("raw"), F.col("value_type"))
        v = v.select(entity, "key_id", *[c.cast(TYPES[t]).alias(f"v_{t}") for t, c in cols.items()]).filter(" or ".join(f"v_{t} is not null" for t in TYPES))
        self._save(v, self.path + "/attributes", self.name, "key_id")
        self._save(spine.select(entity), self.path + "/spine", self.name + "_spine", None)

    def __enter__(self) -> NarrowTables:
        # a task writes one sorted file per table and bucket, so the joins need no sort either: with
        # dozens of inputs to one stage, as many sorters would share a task's memory
        self.before = self.spark.conf.get(_OPTION, None)
        self.spark.conf.set(_OPTION, "true")
        return self

    def __exit__(self, *exc: object) -> None:
        if self.before is None:
            self.spark.conf.unset(_OPTION)
        else:
            self.spark.conf.set(_OPTION, self.before)
        for t in (self.name, self.name + "_spine"):
            self.spark.sql(f"drop table if exists {t}")
        remove(self.spark, self.path)

    def _save(self, df: DataFrame, path: str, name: str, by: str | None) -> None:
        w = df.repartition(self.buckets, self.entity).write.format("parquet").option("path", path).bucketBy(self.buckets, self.entity).sortBy(self.entity)
        (w.partitionBy(by) if by else w).saveAsTable(name)

    def spine(self) -> DataFrame:
        return self.spark.table(self.name + "_spine")

    def narrow(self, a: Attribute) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("key_id") == a.key_id).select(self.entity, F.col(f"v_{a.type}").alias(a.column))

    def wide(self) -> DataFrame:
        """entity and one column per attribute: a row for every entity of the spine."""

        def leaf(part: list[Attribute]) -> DataFrame:
            out = self.spine()
            for a in part:
                out = out.join(self.narrow(a).hint("merge"), self.entity, "left")
            return out

        level = [leaf(self.attrs[i : i + FAN_IN]) for i in range(0, len(self.attrs), FAN_IN)] or [self.spine()]
        while len(level) > 1:  # both sides hold every entity once, so an inner join is an outer one
            level = [level[i].join(level[i + 1].hint("merge"), self.entity) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]


def wide_nodes(log: DataFrame, keys: DataFrame) -> tuple[DataFrame, list[Attribute]]:
    """One row per node that exists at the end of the log, with a typed column per declared node key.

    A cell is null if the property was never set, was removed, is JSON null, an object or a list, or
    cannot be read in its key's type. Undeclared keys are left out.
    """
    attrs = attributes(keys)
    nodes = node_lives(committed(log.filter("op in ('AddNode', 'DelNode')").select("lsn", "txn_id", "op", "vid"), log))
    values = last_values(node_attributes(log)).join(nodes, "vid").filter("lsn >= since")
    with NarrowTables(values, nodes, attrs, buckets=bucket_count(log)) as t:
        return written(t.wide(), "wide"), attrs


def cells(wide: DataFrame, attrs: Sequence[Attribute], entity: str = "vid") -> DataFrame:
    """(entity, key_id, cell) of the wide table's cells that are not null, as text.

    An int in plain digits, a double times 1000 in plain digits, true or false, or the string.
    """
    show = {"int": lambda c: c.cast("string"), "double": lambda c: F.round(c * 1000).cast("decimal(38,0)").cast("string"), "bool": lambda c: c.cast("string"), "string": lambda c: c}
    each = F.array(*[F.struct(F.lit(a.key_id).cast("int").alias("key_id"), show[a.type](F.col(a.column)).alias("cell")) for a in attrs])
    return wide.select(entity, F.explode(each).alias("x")).filter("x.cell is not null").select(entity, "x.key_id", "x.cell")


def node_cells(log: DataFrame, keys: DataFrame) -> DataFrame:
    wide, attrs = wide_nodes(log, keys)
    if not attrs:
        return log.sparkSession.createDataFrame([], "vid long, key_id int, cell string")
    return cells(wide, attrs)


def named(wide: DataFrame, attrs: Sequence[Attribute]) -> DataFrame:
    """The wide table with attribute names; a name that clashes gets its key id."""
    seen: set[str] = {"vid"}
    out = []
    for a in attrs:
        n = a.name if a.name and a.name.lower() not in seen else f"{a.name}_{a.key_id}"
        seen.add(n.lower())
        out.append(F.col(a.column).alias(n))
    return wide.select("vid", *out)


def from_rows(spark: SparkSession, rows: DataFrame, entity: str, attrs: Sequence[Attribute]) -> DataFrame:
    """The general form: rows (entity, key_id, lsn, kind, raw) of any source into a wide table of all their entities."""
    values = last_values(rows.filter(F.col(entity).isNotNull()), entity)
    with NarrowTables(values, values.select(entity).distinct(), attrs, entity, bucket_count(rows)) as t:
        return written(t.wide(), "wide")
