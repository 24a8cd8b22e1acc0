"""As-of join: against looking at every row, with hot keys over many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators.asof import asof_join


def brute(left, right):
    out = []
    for row in left:
        k, t = row[1], row[2]
        near = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        top = max((r[1] for r in near), default=None)
        out.append((*row, max([r for r in near if r[1] == top], key=lambda r: r[2])[2] if near else None))
    return sorted(out, key=repr)


def got(spark, left, right):
    a = spark.createDataFrame(left, "id long, `k.x` string, t long, side string")
    b = spark.createDataFrame(right, "k string, at long, v long").withColumnRenamed("k", "k.x")
    out = asof_join(a, b, ["k.x"], "t", "at")
    assert out.columns == ["id", "k.x", "t", "side", "last_k.x", "last_at", "last_v"]
    return sorted(((r[0], r[1], r[2], r[3], r[6]) for r in out.collect()), key=repr)


@pytest.fixture(params=[True, False])
def many_tasks(spark, request):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": str(not request.param).lower(), "spark.sql.shuffle.partitions": "16" if request.param else "4", "spark.sql.execution.arrow.maxRecordsPerBatch": "7" if request.param else "10000"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("hot", [0.0, 0.95, 1.0])
def test_equals_brute_force(spark, many_tasks, hot):
    rng = random.Random(int(hot * 100))
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "c", "d", None])
    left = [(k, key(), rng.choice([None, *range(0, 400)]), "l") for k in range(500)]
    left += left[:20]
    right = [(key(), rng.choice([None, *range(100, 500, 7)]), rng.randint(0, 9)) for k in range(150 if hot < 1 else 5)]
    assert got(spark, left, right) == brute(left, right)


def test_a_match_may_be_many_tasks_back(spark, many_tasks):
    left = [(k, "hot", 10 + k, "l") for k in range(600)]
    assert got(spark, left, [("hot", 9, 7), ("hot", 300, 8), ("cold", 400, 9)]) == sorted(((*r, 7 if r[2] < 300 else 8) for r in left), key=repr)
    same = [(k, "hot", 5, "l") for k in range(600)]  # equal in key and time
    assert {r[4] for r in got(spark, same, [("hot", 5, v) for v in range(40)])} == {39}


def test_empty_tables(spark):
    assert got(spark, [], [("a", 1, 1)]) == [] and got(spark, [(1, "a", 1, "l"), (2, None, None, "l")], []) == [(1, "a", 1, "l", None), (2, None, None, "l", None)]
