"""Conditions on element properties: against Python's reading of the same JSON."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.operators import elements, properties
from pagewright.operators.properties import Property

VALUES = [
    {"a": 1, "b": {"c": "x", "d": [1, "two", {"e": True}]}}, {"a": 1.5, "b": {"c": "xyz"}}, {"a": "1", "b": "x"}, {"a": True, "b": {"c": None}}, {"a": None}, {}, {"b": [1, 2]}, {"a": 12345678901234567890.0}, {"a": -3, "b": {"d": []}}, {"a": "été"}, [1, 2], "text",
]
CONDITIONS = [
    Property("a", "eq", 1), Property("a", "eq", 1.0), Property("a", "ne", 1), Property("a", "eq", "1"), Property("a", "eq", True), Property("a", "ne", True), Property("a", "gt", 1), Property("a", "le", 1.5), Property("a", "in", (1, -3)),
    Property("a", "not_in", (1, -3)), Property("a", "in", ("1", "été")), Property("a", "exists"), Property("a", "missing"), Property("a", "null"), Property("b.c", "starts", "x"), Property("b.c", "contains", "yz"), Property("b.c", "null"),
    Property("b.c", "missing"), Property("b.d[1]", "eq", "two"), Property("b.d[2].e", "eq", True), Property("b.d[7]", "missing"), Property("b[1]", "eq", 2), Property("b.c.z", "missing"), Property("a", "ge", "a"),
]
NOTHING = object()


def reached(value, path):
    for step in properties._STEP.findall(path):
        if step.startswith("["):
            k = int(step[1:-1])
            if not isinstance(value, list) or k >= len(value):
                return NOTHING
            value = value[k]
        elif not isinstance(value, dict) or step not in value:
            return NOTHING
        else:
            value = value[step]
    return value


def holds(value, p):
    got = reached(value, p.path)
    if p.op in ("exists", "missing", "null"):
        return {"exists": got is not NOTHING, "missing": got is NOTHING, "null": got is None}[p.op]
    wanted = p.value if p.op in ("in", "not_in") else (p.value,)
    if got is NOTHING or got is None or isinstance(got, (dict, list)) or properties.kind_of(got) != properties.kind_of(wanted[0]):
        return False
    one = wanted[0]
    return {
        "eq": lambda: got == one, "ne": lambda: got != one, "lt": lambda: got < one, "le": lambda: got <= one, "gt": lambda: got > one, "ge": lambda: got >= one, "in": lambda: got in wanted, "not_in": lambda: got not in wanted,
        "contains": lambda: one in got, "starts": lambda: got.startswith(one),
    }[p.op]()


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, json.dumps(v)) for k, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "k int, j string").select("k", F.parse_json("j").alias("properties")).cache()


@pytest.mark.parametrize("p", CONDITIONS, ids=str)
def test_conditions(values, p):
    got = sorted(r.k for r in values.where(properties.condition(p)).select("k").collect())
    assert got == [k for k, v in enumerate(VALUES) if holds(v, p)]


@pytest.mark.parametrize("path", ["", ".", "a.", ".a", "a..b", "a[", "a[x]", "a b", "$.a", "a['b']", "a-b"])
def test_paths_are_checked(path):
    with pytest.raises(ValueError):
        Property(path)


def test_values_are_checked():
    for op, value in (("like", "a"), ("eq", None), ("eq", [1]), ("contains", 1), ("in", (1, "a")), ("in", ()), ("in", 1)):
        with pytest.raises(ValueError):
            Property("a", op, value)
    assert properties.json_path("a.b[0][1].c") == "$.a.b[0][1].c"


def test_elements_have_properties(spark):
    pages = spark.createDataFrame([("p", 1, "one\ntwo words", '{"format": "JPEG", "size": 7}'), ("q", 1, "x", "Link"), ("r", 2, "y", None)], "path string, page_number int, text string, d string")
    found = elements.line_elements(pages).drop("detail").join(pages.select(F.col("path").alias("p"), F.col("d").alias("detail")), F.col("path") == F.col("p")).drop("p")
    paths = lambda *conditions: sorted(r.element_id + r.path for r in properties.where(found, conditions).collect())
    assert paths(Property("detail.size", "eq", 7)) == ["line_1_0p", "line_1_1p"] and paths(Property("detail", "eq", "Link")) == ["line_1_0q"]
    assert paths(Property("box.width", "ge", 468), Property("line", "eq", 1)) == ["line_1_1p"] and paths(Property("word", "exists"), Property("word", "null")) == paths()
    assert paths(Property("top", "eq", False)) == [] and len(paths(Property("top", "eq", True), Property("font_size", "gt", 0))) == 4
    assert properties.where(found, []).columns == found.columns
