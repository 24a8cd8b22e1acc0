"""Stored sketches: merged ones against exact numbers."""

import random

from pyspark.sql import functions as F

from pagewright.operators import sketches


def test_merged_sketches_are_within_their_bounds(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.choice(["d1", "d2", None]), rng.gauss(0, 1), rng.randint(0, 9000)) for _ in range(40_000)]
    df = spark.createDataFrame(rows, "folder string, day string, size double, user long")
    half = [sketches.build(df.where(c), ["folder", "day"], "size", "user") for c in ("user % 2 = 0", "user % 2 = 1")]  # built apart, kept side by side
    stored = half[0].unionByName(half[1])
    out = sketches.estimates(sketches.rollup(stored, [["folder", "day"], ["folder"], ["day"], []], ["folder", "day"])).collect()
    assert len(out) == 12 + 4 + 3 + 1 and sorted({r.level for r in out}) == [0, 1, 2]
    for r in out:
        mine = [x for x in rows if (r.level == 0) or (r.level == 2 and x[:2] == (r.folder, r.day)) or (r.level == 1 and (x[0] == r.folder if r.folder is not None else x[1] == r.day))]
        assert r.n == len(mine) and abs(r.total - sum(x[2] for x in mine)) < 1e-6
        assert abs(r.distinct - len({x[3] for x in mine})) <= 0.05 * len({x[3] for x in mine})
        for q, got in ((0.5, r.q50), (0.95, r.q95)):
            assert abs(sum(x[2] <= got for x in mine) / len(mine) - q) <= sketches.RANK_ERROR


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, None), ("b", 1.0, 5)], "k string, v double, u long")
    out = {r.k: r for r in sketches.estimates(sketches.rollup(sketches.build(df, ["k"], "v", "u"), [["k"]], ["k"])).collect()}
    assert (out["a"].n, out["a"].distinct, out["a"].q50) == (2, 0, None) and (out["b"].n, out["b"].distinct, out["b"].q50) == (1, 1, 1.0)
    assert sketches.rollup(sketches.build(df.limit(0), ["k"], "v", "u"), [["k"]], ["k"]).count() == 0
    assert [r[0] for r in df.select(sketches.within(F.lit(105), F.lit(100))).distinct().collect()] == [True]
