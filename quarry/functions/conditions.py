"""Metadata filters as trees: {"language": "python"}, {"size": {"gt": 5}}, {"and": [tree, tree]}, {"or": [...]}.

Operators are eq, ne, in, nin, gt, gte, lt, lte, and, or, with or without a leading ``$``; several fields, or several
operators of a field, must all hold. A tree becomes one Column, so that the parts that concern columns are pushed to the
scan. A field is a column, or else a key of a map column of strings, where numbers are compared as numbers and the rest as text.

A row without the field (null, or no such key) meets no condition but ne and nin: what isn't there equals nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPARISONS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte")
COMBINATIONS = ("and", "or")
_ORDER = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
Value = str | int | float | bool


def _name(key: str) -> str:
    return key.removeprefix("$")


def _checked(value: object, op: str, field: str) -> Value:
    if not isinstance(value, str | int | float | bool):
        raise ValueError(f"{op} of {field!r} compares with a string, number or boolean, not with {type(value).__name__}")
    return value


def _field(df: DataFrame, field: str, map_col: str) -> Callable[[Value], tuple[Column, Column]]:
    """Pairs of the field and a value as columns of one type."""
    if field in df.columns:
        numeric = isinstance(df.schema[field].dataType, T.NumericType)
        if not isinstance(df.schema[field].dataType, T.AtomicType):
            raise ValueError(f"{field!r} can't be compared: it is {df.schema[field].dataType.simpleString()}")

        def of_column(value: Value) -> tuple[Column, Column]:
            if numeric != (isinstance(value, int | float) and not isinstance(value, bool)):
                return F.col(field).cast("string"), F.lit(str(value).lower() if isinstance(value, bool) else str(value))
            return F.col(field), F.lit(value)

        return of_column
    if map_col not in df.columns:
        raise ValueError(f"no field {field!r}; there are: {', '.join(df.columns)}")

    def of_map(value: Value) -> tuple[Column, Column]:
        held = F.try_element_at(F.col(map_col), F.lit(field))
        if isinstance(value, int | float) and not isinstance(value, bool):
            return held.try_cast("double"), F.lit(float(value))
        return held, F.lit(str(value).lower() if isinstance(value, bool) else value)

    return of_map


def _compared(pair: Callable[[Value], tuple[Column, Column]], op: str, value: object, field: str) -> Column:
    """True, or false or null, which are alike in a filter: no operator turns a condition round as a whole."""
    if op in ("in", "nin"):
        if not isinstance(value, list | tuple):
            raise ValueError(f"{op} of {field!r} needs a list")
        own = [_compared(pair, "eq" if op == "in" else "ne", v, field) for v in value]
        return reduce(lambda a, b: a | b, own, F.lit(False)) if op == "in" else reduce(lambda a, b: a & b, own, F.lit(True))
    a, b = pair(_checked(value, op, field))
    if op == "ne":
        return a.isNull() | (a != b)
    return a == b if op == "eq" else _ORDER[op](a, b)


def condition(df: DataFrame, tree: dict, map_col: str = "metadata") -> Column:
    """The tree as a Column over ``df`` to filter by (null is as good as false); an empty tree holds for every row. What can't
    be read is a ValueError that names it."""
    if not isinstance(tree, dict):
        raise ValueError(f"a filter is a dictionary, not {type(tree).__name__}")
    parts: list[Column] = []
    for key, value in tree.items():
        op = _name(key)
        if op in COMBINATIONS and (key.startswith("$") or key not in df.columns):
            if not isinstance(value, list | tuple) or not value:
                raise ValueError(f"{key} needs a list of filters")
            own = [condition(df, v, map_col) for v in value]
            parts.append(reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), own))
        elif key.startswith("$"):
            raise ValueError(f"no operator {key!r} here; there are: {', '.join(COMBINATIONS)}")
        else:
            pair = _field(df, key, map_col)
            for name, wanted in value.items() if isinstance(value, dict) else (("eq", value),):
                if _name(name) not in COMPARISONS:
                    raise ValueError(f"no operator {name!r} for {key!r}; there are: {', '.join(COMPARISONS)}")
                parts.append(_compared(pair, _name(name), wanted, key))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
