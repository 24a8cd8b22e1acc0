"""Proximity groups and complete mode: against brute force."""

import itertools
import random

import pytest

from pagewright.config import TableRules
from pagewright.operators import elements, proximity, tables
from pagewright.schema import ELEMENTS

BOXES = "path string, page_number int, element_id string, llx double, lly double, urx double, ury double, text string, label int"


def brute(rows, distance):
    """Least element id of each row's group, by looking at all pairs of a page again and again."""
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    finite = lambda r: r[0] is not None and r[1] is not None and all(v is not None and abs(v) <= 1e9 for v in r[3:7])
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if a[:2] != b[:2] or not (finite(a) and finite(b)):
            continue
        ax, ay, bx, by = (sorted(v) for v in ((a[3], a[5]), (a[4], a[6]), (b[3], b[5]), (b[4], b[6])))
        dx, dy = max(0.0, bx[0] - ax[1], ax[0] - bx[1]), max(0.0, by[0] - ay[1], ay[0] - by[1])
        if dx * dx + dy * dy <= distance * distance:
            up[root(i)] = root(j)
    members = {}
    for k, r in enumerate(rows):
        members.setdefault(root(k), []).append(r[2])
    return sorted((str(r[0]), str(r[1]), r[2], min(members[root(k)]), len(members[root(k)])) for k, r in enumerate(rows))


def got(spark, rows, distance, **options):
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], BOXES)
    return sorted((str(r.path), str(r.page_number), r.element_id, r.group_id, r.group_size) for r in proximity.groups(df, distance, **options).collect())


@pytest.mark.parametrize("distance,spread,cell", [(20.0, 600, 64.0), (0.0, 60, 8.0), (3.5, 200, 1000.0)])
def test_groups_equal_brute_force(spark, distance, spread, cell):
    rng = random.Random(int(distance * 10) + spread)
    rows = []
    for k in range(260):
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        w, h = rng.choice([0, 5, 30, spread]), rng.choice([0, 5, 12])
        rows.append((f"p{k % 3}", k % 2, f"e{k:04d}", round(x), round(y), round(x) + w, round(y) + h))
    rows += [(*r[:2], f"copy{k}", *r[3:]) for k, r in enumerate(rows[:20])]  # equal boxes
    rows += [(*r[:2], r[2], *r[3:]) for r in rows[:5]]  # equal rows
    rows = [tuple(map(float, r[3:])) and (*r[:3], *map(float, r[3:])) for r in rows]
    assert got(spark, rows, distance, cell=cell) == brute(rows, distance)


def test_a_long_chain_is_one_group(spark):
    rows = [("p", 1, f"e{(k * 37) % 500:03d}", 25.0 * k, 0.0, 25.0 * k + 5, 1.0) for k in range(500)]
    assert {(g, n) for *_, g, n in got(spark, rows, 20.0)} == {("e000", 500)}
    assert {n for *_, n in got(spark, rows, 19.9)} == {1}


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_groups_broadcast_nothing(spark):
    """Written tables are many times their files' size as rows, so small files are no reason to collect them."""
    found = proximity.groups(spark.createDataFrame([("p", 1, f"e{k}", 25.0 * k, 0.0, 25.0 * k + 5, 1.0, "t", 0) for k in range(9)], BOXES))
    nodes = proximity._nodes(proximity._boxed(found), 20.0)
    for df in (found, proximity.near_labels(nodes, 20.0)):
        df.collect()
        assert "SortMergeJoin" in planned(df) and "Broadcast" not in planned(df)


def test_elements_without_a_place_are_alone(spark):
    nan = float("nan")
    rows = [("p", 1, "a", 0.0, 0.0, 1.0, 1.0), ("p", 1, "b", nan, 0.0, 1.0, 1.0), ("p", 1, "c", None, 0.0, 1.0, 1.0), (None, 1, "d", 0.0, 0.0, 1.0, 1.0), (None, 1, "e", 0.0, 0.0, 1.0, 1.0),
            ("p", None, "f", 0.0, 0.0, 1.0, 1.0), ("p", 1, "g", float("inf"), 0.0, 1.0, 1.0), ("p", 1, "h", 1.0, 1.0, 0.0, 0.0), ("p", 1, "i", 0.0, 0.0, 1e300, 1.0)]
    assert got(spark, rows, 20.0) == brute(rows, 20.0)
    assert got(spark, [], 20.0) == []


def test_regions_read_their_texts_in_order(spark):
    rows = [("p", 1, "b", 0.0, 0.0, 10.0, 10.0, "below", 0), ("p", 1, "a", 0.0, 12.0, 10.0, 22.0, "above", 0), ("p", 1, "c", 100.0, 0.0, 110.0, 10.0, None, 0)]
    found = {r.group_id: r for r in proximity.regions(proximity.groups(spark.createDataFrame(rows, BOXES))).collect()}
    assert found["a"].text == "above\nbelow" and (found["a"].llx, found["a"].ury, found["a"].n_elements) == (0.0, 22.0, 2) and found["c"].text == ""


def test_regions_broadcast_nothing(spark):
    found = proximity.regions(proximity.groups(spark.createDataFrame([("p", 1, f"e{k}", 25.0 * k, 0.0, 25.0 * k + 5, 1.0, "t", 0) for k in range(9)], BOXES)))
    assert found.collect()[0].n_elements == 9 and "Broadcast" not in planned(found)


def test_complete_mode_has_tables(spark):
    pages = spark.createDataFrame([("one", 1, "a\nb\nc\nd"), ("none", 1, "a\nb"), ("two", 1, "a\nb\nc\nd"), ("two", 2, "e\nf\ng\nh")], "path string, page_number int, text string")
    found = elements.line_elements(pages)
    both = tables.with_tables(found, TableRules(threshold=0.7), grid=True)
    assert both.columns == list(ELEMENTS) and both.where("type <> 'table'").count() == found.count()
    table = {r.path: r for r in both.where("type = 'table'").collect()}
    assert set(table) == {"one", "two"} and table["two"].element_id == "table_1_0"
    assert '"cells":8' in table["two"].detail and '"columns":2' in table["two"].detail and '"rows":4' in table["two"].detail
    assert (table["one"].llx, table["one"].lly, table["one"].urx, table["one"].ury, table["one"].confidence) == (72.0, 684.0, 540.0, 732.0, 1.0)
    assert tables.with_tables(found.limit(0), TableRules(), grid=False).count() == 0
