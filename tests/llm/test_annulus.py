"""Exact k-means by annulus search: against all-centroid rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from pagewright.llm import annulus


def brute(rows, dim, k, rounds, salt):
    """rows: (id, vector) of usable vectors, in plain integers."""
    ints = [(i, [math.floor(v) * 1024 + math.floor((v - math.floor(v)) * 1024) for v in x]) for i, x in rows]
    start = sorted(((hashlib.sha256(f"{salt}{'null' if i is None else i}".encode()).hexdigest(), i, x) for i, x in ints), key=lambda t: (t[0], t[2]))
    centroids = [x for _, _, x in start[:k]]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        of = [nearest(x)[0] for _, x in ints]
        for c in range(len(centroids)):
            mine = [x for (_, x), o in zip(ints, of) if o == c]
            if mine:
                centroids[c] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted((i, *nearest(x)) for i, x in ints), centroids


def frame(spark, rows, kind="array<double>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int")


def check(spark, rows, dim, k=3, rounds=4):
    got, centroids = annulus.cluster(frame(spark, [(i, x, 0) for i, x in rows]), dim=dim, k=k, rounds=rounds)
    want, wanted = brute(rows, dim, k, rounds, annulus.SALT)
    assert centroids == wanted
    fits = lambda d: d if d < 1 << 63 else None
    assert sorted(tuple(r) for r in got.collect()) == [(i, c, fits(d)) for i, c, d in want]
    return got, centroids


def test_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5) + 4 * (i % 3)]) for i in range(200)]
    check(spark, rows, 5)


def test_ties_go_to_the_smaller_number_and_copies_make_empty_clusters(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)] + [(100 + i, [1.5, 0.0]) for i in range(20)]
    check(spark, rows, 2, k=4)
    check(spark, [(i, [0.25, -0.25]) for i in range(40)], 2, k=4)  # all equal: three clusters stay empty


def test_negative_sums_are_floored_and_large_components_stay_exact(spark):
    rows = [(0, [-0.001, 0.0]), (1, [-0.0005, 3.0]), (2, [1e300, -1e300]), (3, [9.9e299, 2.0]), (4, [2.0**40 + 0.5, -(2.0**40) - 0.25]), (5, [300000.0, 1.0])]
    check(spark, rows, 2, k=2)
    check(spark, rows[:2] + rows[4:], 2, k=2, rounds=10)


def test_an_inertia_beyond_a_long_is_null(spark):
    rows = [(i, [3e5 * i, 0.0]) for i in range(2000)]
    got, centroids = annulus.cluster(frame(spark, [(i, x, 0) for i, x in rows]), dim=2, k=1, rounds=1)
    out = annulus.with_inertia(got, centroids).collect()
    assert len(out) == 2000 and {r.inertia for r in out} == {None} and {r.cluster_inertia for r in out} == {None}
    assert {r.centroid_sha256 for r in out} == {hashlib.sha256(",".join(map(str, centroids[0])).encode()).hexdigest()}


def test_unusable_rows_go_and_other_columns_are_not_read(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (1, [2.0, 2.0]), (2, [0.0, 0.0])]
    bad = [(3, None), (4, []), (5, [1.0]), (6, [1.0, nan]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, x, "a", 1) for i, x in good + bad], "vec_id long, embedding array<double>, e string, cluster int")
    out, _ = annulus.cluster(df, dim=2, k=8)
    want, _ = brute(good, 2, 8, 10, annulus.SALT)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert out.columns == ["vec_id", "cluster", "distance"]


def test_null_ids_and_empty_tables(spark):
    out, centroids = annulus.cluster(frame(spark, [(None, [1.0], 0), (None, [1.0], 0), (7, [3.0], 0)]), dim=1, k=2)
    assert len(centroids) == 2 and len(out.collect()) == 3 and {r.distance for r in out.filter('vec_id is null').collect()} == {0}
    out, centroids = annulus.cluster(frame(spark, []), dim=1)
    assert centroids == [] and out.collect() == []
    assert annulus.with_inertia(out, centroids).collect() == []


def test_only_the_annulus_is_compared():
    rng = np.random.default_rng(3)
    centroids = [[int(1000 * r), 0] for r in range(1, 65)]
    x = np.array([[int(1000 * r + rng.integers(-200, 200)), int(rng.integers(-200, 200))] for r in rng.integers(1, 65, 500)])
    search = annulus.Annulus(centroids)
    number, least, compared = search.nearest(x)
    full = ((x[:, None, :] - np.array(centroids)[None]) ** 2).sum(2)
    assert (number == full.argmin(1)).all() and (least == full.min(1)).all()
    assert compared < 3 * len(x)  # of 64 a vector


@pytest.mark.parametrize("value", [0, 5, -5, (1 << 30) - 1, -(1 << 30), 1 << 30, (1 << 1034) + 77, -(1 << 1034) - 77])
def test_limbs_add_up(value):
    assert annulus.value_of(dict(enumerate(annulus.limbs_of(value)))) == value
    assert all(-(1 << 30) <= v <= 1 << 30 for v in annulus.limbs_of(value))
