"""Every query over the generated library, against its SQL."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import library

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in entry.queries().items() if f.__module__ == library.__name__)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = tables.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_every_verb_has_a_query():
    from pagewright.api import TOOLS

    named = {n.removeprefix("tool_") for n in NAMES}
    assert {t.removeprefix("pdf_") for t in TOOLS} <= named
