"""Predicates from filter documents: clause trees, equality maps, and operator documents. Missing values never match."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Resolve = Callable[[str], Column]


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs, F.lit(True))


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


def condition(c: dict[str, Any], resolve: Resolve = F.col, id_col: str = "id") -> Column:
    """One condition: {key, match}, {key, range} or {has_id}; false where the value is null."""
    if "has_id" in c:
        return F.coalesce(F.col(id_col).isin(list(c["has_id"])), F.lit(False))
    value = resolve(c["key"])
    if "match" in c:
        return F.coalesce(value == F.lit(c["match"]), F.lit(False))
    if "range" in c:
        ops = {"gte": lambda v, x: v >= x, "gt": lambda v, x: v > x, "lte": lambda v, x: v <= x, "lt": lambda v, x: v < x}
        number = value.try_cast("double")
        return F.coalesce(_all([ops[k](number, F.lit(float(x))) for k, x in c["range"].items()]), F.lit(False))
    raise ValueError(f"unknown condition {sorted(c)}")


def clauses(doc: dict[str, list], resolve: Resolve = F.col, id_col: str = "id") -> Column:
    """{must, should, must_not} of conditions or of such documents again."""
    one = lambda c: clauses(c, resolve, id_col) if {"must", "should", "must_not"} & set(c) else condition(c, resolve, id_col)
    out = _all([one(c) for c in doc.get("must", [])]) & ~_any([one(c) for c in doc.get("must_not", [])])
    return out & _any([one(c) for c in doc["should"]]) if doc.get("should") else out


def where(doc: dict[str, Any], resolve: Resolve = F.col) -> Column:
    """A map of equalities, all of which must hold."""
    return F.coalesce(_all([resolve(k) == F.lit(v) for k, v in doc.items()]), F.lit(False))


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "equals": lambda c, v: c == F.lit(v), "not_equals": lambda c, v: c != F.lit(v),
    "greater_than": lambda c, v: c > F.lit(v), "less_than": lambda c, v: c < F.lit(v),
    "greater_equal": lambda c, v: c >= F.lit(v), "less_equal": lambda c, v: c <= F.lit(v),
    "between": lambda c, v: c.between(F.lit(v[0]), F.lit(v[1])),
    "contains": lambda c, v: c.contains(v), "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v), "regex": lambda c, v: c.rlike(v),
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)),
    "exists": lambda c, v: c.isNotNull(), "not_exists": lambda c, v: c.isNull(),
}
ALIASES = {
    "$eq": "equals", "$ne": "not_equals", "$gt": "greater_than", "$lt": "less_than", "$gte": "greater_equal", "$lte": "less_equal", "$in": "in", "$nin": "not_in",
    "$between": "between", "$regex": "regex", "$contains": "contains", "=": "equals", "!=": "not_equals", ">": "greater_than", "<": "less_than", ">=": "greater_equal", "<=": "less_equal",
}


def operator(name: str, value: Column, argument: Any) -> Column:
    name = ALIASES.get(name, name)
    if name == "$exists":
        name = "exists" if argument else "not_exists"
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}")
    return F.coalesce(OPERATORS[name](value, argument), F.lit(False))


def document(doc: dict[str, Any], resolve: Resolve = F.col) -> Column:
    """{field: value}, {field: {op: argument}}, {$and | $or: [documents]}, {$not: document}."""
    parts = []
    for key, value in doc.items():
        if key in ("$and", "$or"):
            parts.append((_all if key == "$and" else _any)([document(d, resolve) for d in value]))
        elif key == "$not":
            parts.append(~document(value, resolve))
        elif isinstance(value, dict):
            parts.append(_all([operator(op, resolve(key), x) for op, x in value.items()]))
        else:
            parts.append(operator("equals", resolve(key), value))
    return _all(parts)


def json_field(column: str, kind: str = "double") -> Resolve:
    """Resolves keys to top-level fields of a JSON string column."""
    return lambda key: F.get_json_object(F.col(column), f"$.{key}").try_cast(kind)


def glob(path: Column, pattern: str) -> Column:
    """*, *.ext, dir/* and exact names."""
    import re

    return path.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def accepted(path: Column, include: list[str], exclude: list[str]) -> Column:
    return _any([glob(path, p) for p in include]) & ~_any([glob(path, p) for p in exclude])


def free_text(needle: str, *columns: Column) -> Column:
    return _any([F.coalesce(F.lower(c.cast("string")).contains(needle.lower()), F.lit(False)) for c in columns])


def metadata(size: tuple | None = None, created: tuple | None = None, modified: tuple | None = None, dims: int | None = None, kind: str | None = None, max_distance: float | None = None) -> Column:
    """The fixed filter over columns size, created, modified, dims, kind and distance; bounds are inclusive and may be None."""
    parts = []
    for name, bounds in (("size", size), ("created", created), ("modified", modified)):
        low, high = bounds or (None, None)
        parts += [F.col(name) >= F.lit(low)] if low is not None else []
        parts += [F.col(name) <= F.lit(high)] if high is not None else []
    parts += [F.col("dims") == dims] if dims is not None else []
    parts += [F.col("kind") == kind] if kind is not None else []
    parts += [F.col("distance") <= max_distance] if max_distance is not None else []
    return F.coalesce(_all(parts), F.lit(False))


def unless_zero(value: Column, low: float = 0, high: float = 0) -> Column:
    """Bounds where 0 means that there is none, and an upper one counts only above the lower."""
    parts = [value >= F.lit(low)] if low else []
    return F.coalesce(_all(parts + ([value <= F.lit(high)] if high > low else [])), F.lit(False))


def extension(path: Column) -> Column:
    """The lower-case ending of a path's last part, '' if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def sane(confidence: Column, distance: Column, score: Column) -> Column:
    """Results worth showing: some confidence, and finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return (confidence > 0.1) & finite(distance) & finite(score)


def path_constraints(path: Column, types: Column, shortest: int | None = None, longest: int | None = None, required: list[str] = (), forbidden: list[str] = (), unique_nodes: bool = False) -> Column:
    """Paths (arrays of nodes, and of the types of their edges) of so many edges, with and without sequences of edge types, and without a node twice."""
    joined = F.concat(F.lit("/"), F.array_join(types, "/"), F.lit("/"))
    has = lambda names: joined.contains("/" + "/".join(names) + "/")
    parts = [F.size(types) >= shortest] if shortest is not None else []
    parts += [F.size(types) <= longest] if longest is not None else []
    parts += [has(required)] if required else []
    parts += [~has(forbidden)] if forbidden else []
    parts += [F.size(F.array_distinct(path)) == F.size(path)] if unique_nodes else []
    return _all(parts)
