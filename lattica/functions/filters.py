"""Metadata filters: a small language of conditions compiled to one Catalyst predicate.

Two-valued: a condition on a field that is missing, null or of another type is false; only ``ne`` and ``not_in``
are then true.  Numbers compare as doubles, strings in code-point order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegralType, MapType, NumericType, StringType, StructType, VariantType

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "exists")
_RESERVED = {"and", "or", "not", "field", "operator", "value"}


@dataclass(frozen=True)
class Field:
    """A field as each type it may have; null where it isn't of that type."""

    number: Column
    string: Column
    boolean: Column
    present: Column
    strings: Column | None = None
    numbers: Column | None = None
    whole: Column | None = None


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def typed_field(column: Column, kind) -> Field:
    """A field kept in a typed column: such conditions reach the Parquet scan."""
    is_array = isinstance(kind, ArrayType)
    return Field(
        number=column.cast("double") if isinstance(kind, NumericType) else _nothing("double"),
        string=column if isinstance(kind, StringType) else _nothing("string"),
        boolean=column if isinstance(kind, BooleanType) else _nothing("boolean"),
        present=column.isNotNull(),
        strings=column if is_array and isinstance(kind.elementType, StringType) else None,
        numbers=column.cast("array<double>") if is_array and isinstance(kind.elementType, NumericType) else None,
        whole=column if isinstance(kind, IntegralType) else None,
    )


def variant_field(column: Column, path: str) -> Field:
    """A field of a VARIANT column; ``path`` is a name, or names joined by dots."""
    where = "$" + "".join("[" + json.dumps(part) + "]" for part in path.split("."))
    value = F.try_variant_get(column, where, "variant")
    kind = F.schema_of_variant(value)
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)")
    return Field(
        number=F.when(is_number, F.try_variant_get(column, where, "double")),
        string=F.when(kind == "STRING", F.try_variant_get(column, where, "string")),
        boolean=F.when(kind == "BOOLEAN", F.try_variant_get(column, where, "boolean")),
        present=value.isNotNull() & ~F.is_variant_null(value),
        strings=F.when(kind.startswith("ARRAY<STRING"), F.try_variant_get(column, where, "array<string>")),
        numbers=F.when(kind.rlike("^ARRAY<(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(column, where, "array<double>")),
    )


def resolver(df: DataFrame, metadata_col: str | None = None) -> Callable[[str], Field]:
    """Finds a field among the columns of ``df``, else in its metadata: a VARIANT, JSON string, map or struct column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def find(name: str) -> Field:
        if name in kinds and name != metadata_col:
            return typed_field(F.col(f"`{name}`"), kinds[name])
        if metadata_col is None:
            return Field(_nothing("double"), _nothing("string"), _nothing("boolean"), F.lit(False))
        kind, column = kinds[metadata_col], F.col(f"`{metadata_col}`")
        if isinstance(kind, MapType):
            return typed_field(column[name], kind.valueType)
        if isinstance(kind, StructType):
            return typed_field(column[name], kind[name].dataType) if name in kind.names else Field(_nothing("double"), _nothing("string"), _nothing("boolean"), F.lit(False))
        return variant_field(column if isinstance(kind, VariantType) else F.try_parse_json(column), name)

    return find


def _number(field: Field, value: float) -> tuple[Column, Column]:
    """Sides of a comparison: of whole numbers as such, which a scan can take over, else of doubles."""
    if field.whole is not None and value == value // 1 and abs(value) < 2**31:
        return field.whole, F.lit(int(value))
    return field.number, F.lit(float(value))


def _equal(field: Field, value) -> Column:
    if value is None:
        return ~field.present
    if isinstance(value, bool):
        return field.boolean == value
    if isinstance(value, int | float):
        a, b = _number(field, value)
        return a == b
    if isinstance(value, str):
        return field.string == value
    raise ValueError(f"a filter can't compare with {value!r}")


def _order(field: Field, value) -> tuple[Column, Column]:
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise ValueError(f"a filter can't order by {value!r}")
    return (field.string, F.lit(value)) if isinstance(value, str) else _number(field, value)


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def condition(field: Field, operator: str, value) -> Column:
    """One leaf; null counts as false."""
    if operator == "eq":
        held = _equal(field, value)
    elif operator == "ne":
        return ~F.coalesce(_equal(field, value), F.lit(False))
    elif operator in ("gt", "gte", "lt", "lte"):
        a, b = _order(field, value)
        held = {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[operator]
    elif operator in ("in", "not_in"):
        if not isinstance(value, list | tuple | set):
            raise ValueError(f"{operator} needs a list")
        held = _any([_equal(field, v) for v in value])
        return ~F.coalesce(held, F.lit(False)) if operator == "not_in" else held
    elif operator == "contains":
        parts = []
        if isinstance(value, str):
            parts.append(field.string.contains(value))
            if field.strings is not None:
                parts.append(F.array_contains(field.strings, value))
        elif field.numbers is not None and isinstance(value, int | float) and not isinstance(value, bool):
            parts.append(F.array_contains(field.numbers, float(value)))
        held = _any(parts)
    elif operator == "exists":
        return field.present if value is None or value else ~field.present
    else:
        raise ValueError(f"unknown filter operator: {operator!r}")
    return held


def compile_filter(spec: dict | str | None, find: Callable[[str], Field]) -> Column:
    """The predicate for a filter, never null; see ``predicate``."""
    return F.coalesce(predicate(spec, find), F.lit(False))


def predicate(spec: dict | str | None, find: Callable[[str], Field]) -> Column:
    """The condition, null for false, for a filter: ``{field, operator, value}``, ``{and: [...]}``, ``{or: [...]}``, ``{not: ...}``, together or
    nested; other keys are a shorthand for equality.  An empty filter holds."""
    if isinstance(spec, str):
        spec = json.loads(spec)
    if not spec:
        return F.lit(True)
    held = [predicate(part, find) for part in spec.get("and") or []]
    if spec.get("or"):
        held.append(_any([predicate(part, find) for part in spec["or"]]))
    if spec.get("not"):
        held.append(~compile_filter(spec["not"], find))
    if spec.get("field"):
        held.append(condition(find(spec["field"]), spec.get("operator", "eq"), spec.get("value")))
        extra = {}
    else:
        extra = {k: v for k, v in spec.items() if k not in _RESERVED}
    for name, value in extra.items():
        if isinstance(value, list):
            held.append(condition(find(name), "in", value))
        elif isinstance(value, dict) and set(value) <= set(OPERATORS):
            for operator, inner in value.items():
                held.append(condition(find(name), operator, inner))
        else:
            held.append(condition(find(name), "eq", value))
    return reduce(Column.__and__, held) if held else F.lit(True)


def apply_filter(df: DataFrame, spec: dict | str | None, metadata_col: str | None = None) -> DataFrame:
    """The rows of ``df`` for which the filter holds."""
    return df.where(predicate(spec, resolver(df, metadata_col))) if spec else df
