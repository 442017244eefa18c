"""Operators and functions of the query language as Columns, with static types.

Types are int, double, bool, string, node, edge, null and ``list:<type>``. Equality is null-safe and
two-valued; values of different types are unequal. Comparisons, logic and arithmetic give null for
null, so a filter drops the row; with ``strict`` they raise instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import TYPES
from ..errors import EvalError

NUMBERS = ("int", "double")
Typed = tuple[Column, str]


def literal(v: object) -> Typed:
    if v is None:
        return F.lit(None), "null"
    if isinstance(v, bool):
        return F.lit(v), "bool"
    if isinstance(v, int):
        return F.lit(v).cast("bigint"), "int"
    if isinstance(v, float):
        return F.lit(v), "double"
    if isinstance(v, str):
        return F.lit(v), "string"
    if isinstance(v, (list, tuple)):
        return array([literal(x) for x in v])
    raise EvalError(f"a value can't be {type(v).__name__}")


def spark_type(t: str) -> str:
    if t.startswith("list:"):
        return f"array<{spark_type(t[5:])}>"
    return {"node": "bigint", "edge": "bigint", "null": "string"}.get(t) or TYPES[t]


def common(ts: list[str]) -> str | None:
    """The type that holds all; null fits any. None if there is none."""
    real = [t for t in dict.fromkeys(ts) if t != "null"]
    if not real:
        return "null"
    if len(real) == 1:
        return real[0]
    return "double" if all(t in NUMBERS for t in real) else None


def array(xs: list[Typed]) -> Typed:
    t = common([x[1] for x in xs])
    if t is None:
        raise EvalError("a list holds values of one type")
    return F.array(*[c.cast(spark_type(t)) for c, _ in xs]).cast(f"array<{spark_type(t)}>"), f"list:{t}"


def _guard(strict: bool, what: str, out: Column, *xs: Column) -> Column:
    if not strict:
        return out
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(missing, F.raise_error(F.lit(f"{what} of null"))).otherwise(out)


def equal(a: Typed, b: Typed) -> Column:
    if a[1] == "null" and b[1] == "null":
        return F.lit(True)
    if a[1] == "null":
        return b[0].isNull()
    if b[1] == "null":
        return a[0].isNull()
    if common([a[1], b[1]]) is None:
        return a[0].isNull() & b[0].isNull()
    return a[0].eqNullSafe(b[0])


def compare(op: str, a: Typed, b: Typed, strict: bool) -> Typed:
    if op == "=":
        return equal(a, b), "bool"
    if op == "<>":
        return ~equal(a, b), "bool"
    t = common([a[1], b[1]])
    if t is None or (t not in (*NUMBERS, "string", "bool", "null")):
        raise EvalError(f"{a[1]} {op} {b[1]} can't be compared")
    if "null" in (a[1], b[1]):
        return _guard(strict, op, F.lit(None).cast("boolean"), a[0], b[0]), "bool"
    x, y = a[0], b[0]
    out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return _guard(strict, op, out, x, y), "bool"


def logic(op: str, a: Typed, b: Typed, strict: bool) -> Typed:
    for x in (a, b):
        if x[1] not in ("bool", "null"):
            raise EvalError(f"{op} of {x[1]}")
    x, y = a[0].cast("boolean"), b[0].cast("boolean")
    return _guard(strict, op, x & y if op == "AND" else x | y, x, y), "bool"


def negate(a: Typed, strict: bool) -> Typed:
    if a[1] not in ("bool", "null"):
        raise EvalError(f"NOT of {a[1]}")
    x = a[0].cast("boolean")
    return _guard(strict, "NOT", ~x, x), "bool"


def minus(a: Typed, strict: bool) -> Typed:
    if a[1] not in (*NUMBERS, "null"):
        raise EvalError(f"- of {a[1]}")
    return _guard(strict, "-", -a[0].cast("bigint") if a[1] == "null" else -a[0], a[0]), "int" if a[1] == "null" else a[1]


def arithmetic(op: str, a: Typed, b: Typed, strict: bool) -> Typed:
    t = common([a[1], b[1]])
    if op == "+" and t == "string":
        x, y = a[0].cast("string"), b[0].cast("string")
        return _guard(strict, op, F.concat(x, y), x, y), "string"
    if t not in (*NUMBERS, "null"):
        raise EvalError(f"{a[1]} {op} {b[1]}")
    if t == "null":
        t = "int"
    x, y = a[0].cast(TYPES[t]), b[0].cast(TYPES[t])
    if op == "/":
        if t == "int":
            out = x.cast("double") / y.cast("double")  # x / 0 of whole numbers is an error
        else:
            none = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
            out = F.when(y == 0, none).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))
        return _guard(strict, op, F.when(x.isNotNull() & y.isNotNull(), out), x, y), "double"
    if op == "%":
        out = F.pmod(x, F.abs(y)) if t == "int" else F.when(y == 0, F.lit(float("nan"))).otherwise(F.pmod(x, F.abs(F.when(y == 0, F.lit(1.0)).otherwise(y))))
        return _guard(strict, op, out, x, y), t
    return _guard(strict, op, {"+": x + y, "-": x - y, "*": x * y}[op], x, y), t


def contains(a: Typed, b: Typed) -> Typed:
    """``a IN b``: null-safe like ``=``; a null list holds nothing."""
    if b[1] == "null":
        return F.lit(False), "bool"
    if not b[1].startswith("list:"):
        raise EvalError(f"IN of {b[1]}")
    item = b[1][5:]
    return F.coalesce(F.exists(b[0], lambda x: equal(a, (x, item))), F.lit(False)), "bool"


def size(a: Typed) -> Typed:
    """Length of a string in UTF-16 units, or of a list."""
    if a[1] == "null":
        return F.lit(None).cast("bigint"), "int"
    if a[1] == "string":
        return (F.octet_length(F.encode(a[0], "UTF-16BE")) / 2).cast("bigint"), "int"
    if a[1].startswith("list:"):
        return F.when(a[0].isNotNull(), F.size(a[0])).cast("bigint"), "int"
    raise EvalError(f"size of {a[1]}")


def coalesce(xs: list[Typed]) -> Typed:
    t = common([x[1] for x in xs]) if xs else "null"
    if t is None:
        raise EvalError("coalesce of different types")
    if t == "null":
        return F.lit(None), "null"
    return F.coalesce(*[c.cast(spark_type(t)) for c, _ in xs]), t


def aggregate(name: str, star: bool, x: Typed | None, weight: Column | None = None) -> Typed:
    """An aggregate; with ``weight``, each row stands for so many."""
    if name == "COUNT":
        if weight is not None:
            return F.coalesce(F.sum(weight if star else F.when(x[0].isNotNull(), weight)), F.lit(0).cast("bigint")), "int"  # type: ignore[index]
        return F.count(F.lit(1) if star else x[0]), "int"  # type: ignore[index]
    c, t = x  # type: ignore[misc]
    if name in ("SUM", "AVG"):
        if t not in (*NUMBERS, "null"):
            raise EvalError(f"{name} of {t}")
        c = c.cast("bigint") if t == "null" else c
        if name == "AVG":
            if weight is not None:
                return F.sum(c * weight) / F.sum(F.when(c.isNotNull(), weight)), "double"
            return F.avg(c), "double"
        c = c if weight is None else c * weight
        t = "int" if t == "null" else t
        return F.coalesce(F.sum(c), F.lit(0).cast(TYPES[t])), t
    if name in ("MIN", "MAX"):
        if t not in (*NUMBERS, "string", "bool", "null"):
            raise EvalError(f"{name} of {t}")
        return (F.min(c) if name == "MIN" else F.max(c)), t
    return F.collect_list(c.cast(spark_type(t))), f"list:{t}"
