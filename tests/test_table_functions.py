"""Table functions in SQL text: against the operators over DataFrames."""

import random

import pytest

from pagewright.config import TableRules
from pagewright.functions import table_functions
from pagewright.operators import elements, tables


def test_anchored_rows_equal_the_operator(spark):
    table_functions.register(spark)
    rng = random.Random(4)
    rows = [(f"p{k % 5}", 1, f"e{k:03d}", round(rng.uniform(0, 60), 1)) for k in range(200)]
    pages = spark.createDataFrame([(f"p{k}", 1, "\n".join("x" * 40)) for k in range(5)], "path string, page_number int, text string")
    found = elements.line_elements(pages)
    heights = spark.createDataFrame([(p, e, y) for p, _, e, y in rows], "h_path string, h_id string, y double")
    made = found.limit(0).unionByName(found.crossJoin(heights.limit(0)).select(*found.columns))
    base = found.where("line_idx = 0").join(heights, found.path == heights.h_path).selectExpr(*[c for c in found.columns if c not in ("element_id", "lly")], "h_id as element_id", "y as lly").select(*found.columns)
    made.unionByName(base).createOrReplaceTempView("some_elements")
    for tolerance in (0.0, 2.5, 5.0):
        got = spark.sql(f"SELECT path, element_id, row_index FROM anchored_rows(TABLE(some_elements), {tolerance}D)").collect()
        want = tables.anchored_rows(base, TableRules(row_tolerance=tolerance)).select("path", "element_id", "row_index").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 200
    assert spark.sql("SELECT * FROM anchored_rows(TABLE(some_elements))").columns == [*found.columns, "row_index"]


def test_anchored_rows_need_their_columns(spark):
    table_functions.register(spark)
    spark.range(3).createOrReplaceTempView("numbers")
    with pytest.raises(Exception, match="path and lly"):
        spark.sql("SELECT * FROM anchored_rows(TABLE(numbers))").collect()


def test_glob_matches_by_lateral(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([("a.pdf", ["*.pdf", "a*", "A*", "[", "?.pdf", None]), ("dir/b.pdf", ["*.pdf", "dir/*"]), ("x\n", ["x", "x\n", "x?"]), (None, ["*"]), ("c", None)], "name string, patterns array<string>")
    rows.createOrReplaceTempView("named")
    got = sorted((r.name, r.pattern) for r in spark.sql("SELECT name, pattern FROM named, LATERAL glob_matches(name, patterns)").collect())
    assert got == [("a.pdf", "*.pdf"), ("a.pdf", "?.pdf"), ("a.pdf", "a*"), ("dir/b.pdf", "dir/*"), ("x\n", "x\n"), ("x\n", "x?")]
