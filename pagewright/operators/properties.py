"""Element properties as a VARIANT column, and typed conditions on its paths.

An element's properties are one object: ``detail`` (an object where it is JSON, else a text),
``box`` with width and height, ``font_size``, ``line``, ``word`` and ``top`` (whether it is a top-level
element).  A condition names a path, an operator and a value; it compiles to ``try_variant_get``
and a check of the value's kind, so nothing is cast: the text "1" does not equal the number 1, and
numbers compare as numbers whatever their width.

Defined cases: a missing key and a JSON null are told apart by ``missing`` and ``null``, and meet no
comparison, ``ne`` and ``not_in`` included; a path through something that is no object or list is
missing; a detail that is not JSON is a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMN = "properties"
_STEP = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\[[0-9]+\]")
_COMPARISONS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "contains": lambda a, b: F.contains(a, b), "starts": lambda a, b: F.startswith(a, b),
}
OPERATORS = (*_COMPARISONS, "in", "not_in", "exists", "missing", "null")


def json_path(path: str) -> str:
    """A dotted path, lists by ``[k]``, in the syntax of variants."""
    steps = _STEP.findall(path)
    if not steps or re.sub(r"\.(?=\[)", "", ".".join(steps)) != path:
        raise ValueError(f"not a property path: {path}")
    return "$" + "".join(s if s.startswith("[") else f".{s}" for s in steps)


@dataclass(frozen=True)
class Property:
    """One condition.  The value's Python type says of what kind the property has to be."""

    path: str
    op: str = "exists"
    value: bool | int | float | str | tuple | None = None

    def __post_init__(self) -> None:
        json_path(self.path)
        if self.op not in OPERATORS:
            raise ValueError(f"operator must be one of {', '.join(OPERATORS)}")
        if self.op in ("in", "not_in"):
            if not isinstance(self.value, tuple) or len({kind_of(v) for v in self.value}) != 1:
                raise ValueError("a list of values of one kind is needed")
        elif self.op in _COMPARISONS:
            kind = kind_of(self.value)
            if self.op in ("contains", "starts") and kind != "string":
                raise ValueError(f"{self.op} needs a text")


def kind_of(value) -> str:
    for kind, types in (("boolean", bool), ("double", (int, float)), ("string", str)):
        if isinstance(value, types):
            return kind
    raise ValueError(f"no kind of property: {value!r}")


def typed(properties: Column, path: str, kind: str) -> Column:
    """The value at a path if it is of the kind, else null."""
    found = F.try_variant_get(properties, json_path(path), "variant")
    name = F.schema_of_variant(found)
    right = {"boolean": name == "BOOLEAN", "string": name == "STRING", "double": name.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(name, F.lit("DECIMAL"))}[kind]
    return F.when(right, F.try_variant_get(properties, json_path(path), kind))


def condition(p: Property, properties: Column | None = None) -> Column:
    v = F.col(COLUMN) if properties is None else properties
    found = F.try_variant_get(v, json_path(p.path), "variant")
    if p.op == "exists":
        return F.coalesce(found.isNotNull(), F.lit(False))
    if p.op == "missing":
        return F.coalesce(found.isNull(), F.lit(True))
    if p.op == "null":
        return F.coalesce(F.is_variant_null(found), F.lit(False))
    if p.op in ("in", "not_in"):
        inside = typed(v, p.path, kind_of(p.value[0])).isin(*[float(x) if kind_of(x) == "double" else x for x in p.value])
        return F.coalesce(inside if p.op == "in" else ~inside, F.lit(False))
    kind = kind_of(p.value)
    return F.coalesce(_COMPARISONS[p.op](typed(v, p.path, kind), F.lit(float(p.value) if kind == "double" else p.value)), F.lit(False))


def with_properties(elements: DataFrame) -> DataFrame:
    """elements with their properties as a variant."""
    detail = F.when(F.col("detail").isNotNull(), F.coalesce(F.try_parse_json("detail"), F.parse_json(F.to_json(F.struct(F.col("detail").alias("t"))))))
    # a plain text is no JSON; wrapped it is, and taken out again
    detail = F.when(F.try_parse_json("detail").isNull(), F.try_variant_get(detail, "$.t", "variant")).otherwise(detail)
    number = lambda c: F.col(c).cast("double").alias(c)
    fields = F.struct(
        detail.alias("detail"), F.struct(number("width"), number("height")).alias("box"), F.col("font_size").alias("font_size"),
        F.col("line_idx").alias("line"), F.col("word_idx").alias("word"), (F.col("level") == 0).alias("top"),
    )
    return elements.withColumn(COLUMN, F.to_variant_object(fields))


def where(elements: DataFrame, conditions: Iterable[Property]) -> DataFrame:
    """elements that meet all conditions; those without a properties column get one while it is asked."""
    with_column = elements if COLUMN in elements.columns else with_properties(elements)
    asked = list(conditions)
    if not asked:
        return elements
    # a list of one: the optimiser would else build the properties anew in every condition
    met = F.exists(F.array(COLUMN), lambda v: reduce(lambda a, b: a & b, [condition(p, v) for p in asked]))
    return with_column.where(met).select(*elements.columns)
