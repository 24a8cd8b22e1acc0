"""Pages of sorted relations: against sorting in Python."""

import random

import pytest

from pagewright.operators.paging import pages


def key(row):
    k, name, x = row
    return (k is not None, -k if k is not None else 0, name is not None, name or "", x)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    return [(rng.choice([None, *range(5)]), rng.choice([None, "a", "b", "é"]), rng.randint(0, 50)) for _ in range(400)] + [(1, "a", 7)] * 30


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_pages_cover_all_rows_in_order(spark, rows, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        found = pages(spark.createDataFrame(rows, "k int, `n.x` string, x int"), [("k", False), "n.x"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", r[2]))  # falling: nulls last
    assert found.total == len(rows)
    got = []
    for offset in range(0, len(rows) + 40, 37):
        page = sorted(found.page(offset, 37).collect(), key=lambda r: r.place)
        assert [r.place for r in page] == list(range(offset, min(offset + 37, len(rows))))
        got += [tuple(r)[:3] for r in page]
    assert got == want
    assert found.page(10_000, 5).collect() == [] and found.page(3, 0).collect() == []
    with pytest.raises(ValueError):
        found.page(-1, 5)
    for at in (0, 5, 100, 250, len(want) - 1):
        k, n, _ = want[at]
        after = [r for r in want if (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "") > (k is None, -(k or 0), n is not None, n or "")]
        assert [tuple(r) for r in found.after([k, n], 20).collect()] == after[:20]
    found.close()


def test_a_million_rows(spark):
    found = pages(spark.range(1_000_000).selectExpr("id", "(id * 7919) % 1000003 as k"), ["k"])
    ks = sorted((i * 7919) % 1000003 for i in range(1_000_000))
    for offset in (0, 500_000, 999_990):
        assert [r.k for r in found.page(offset, 20).orderBy("place").collect()] == ks[offset : offset + 20]
    plan = found.page(0, 20)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan  # no sort of everything


def test_an_empty_relation(spark):
    found = pages(spark.createDataFrame([], "k int"), ["k"])
    assert found.total == 0 and found.page(0, 10).collect() == [] and found.after([1], 5).collect() == []
