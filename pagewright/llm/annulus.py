"""Exact integer k-means by annulus search.

Components are integers: floor(1024 * x) of each finite x.  Centroids are sorted by norm.  A
vector's distance to the centroid whose norm is next to its own bounds the distance to
its nearest centroid, and by the triangle inequality a centroid at most so far away has a norm
within that bound of the vector's: two binary searches in the sorted norms give the annulus, and
only its centroids are compared, exactly, in integers.  Norms are doubles, so the annulus is
widened by more than their error: centroids on its boundary are compared as well, and of equal
distances the smaller number wins.

A round is one pass over the written vectors.  Each task adds up its own vectors by cluster and
component before anything is shuffled, so a cluster that holds most vectors is no burden, and the
driver sees the centroids alone: k times the dimension, whatever the number of vectors.

Values are exact at any size: sums travel in limbs of 30 bits, and vectors with components whose
squared distances might not fit into 64 bits (at 64 dimensions x of about 185,000) are compared in
Python's integers.  A distance or inertia that no long holds is null.

Defined cases: vectors of another length, null ones and those with null or non-finite
components are left out, and so are they from the result; a null id hashes as the
text ``null``; of equal hashes the smaller id comes first, then the smaller vector; rows with
equal ids are vectors of their own; with fewer vectors than centroids there are as many centroids as vectors; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, written

DIM, CLUSTERS, ROUNDS, SALT = 64, 8, 10, "3:"
SCALE = 1024
LIMB = 30  # bits
LONG_MAX = (1 << 63) - 1


def small_below(dim: int) -> int:
    """Integers less than this have squared distances that fit into 64 bits."""
    return math.isqrt(LONG_MAX // dim) // 2 - 1


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as 64-bit integers where all are small, else as Python's."""
    if not x.size or np.abs(x).max() * SCALE < small_below(x.shape[1]):
        return np.floor(x * SCALE).astype(np.int64)
    whole = np.floor(x)
    part = np.floor((x - whole) * SCALE).astype(np.int64)  # exact: a part of one has no more bits than x
    return np.array([int(v) * SCALE for v in whole.flat], object).reshape(x.shape) + part


def limbs_of(value: int) -> list[int]:
    """Signed limbs whose sum, each times 2^(30 * place), is the value; the last carries the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def value_of(limbs: dict[int, int]) -> int:
    return sum(v << (LIMB * place) for place, v in limbs.items())


class Annulus:
    """Nearest centroids of many vectors."""

    def __init__(self, centroids: list[list[int]]) -> None:
        big = any(abs(v) > small_below(len(c)) for c in centroids for v in c)
        self.c = np.array(centroids, object if big else np.int64).reshape(len(centroids), -1)
        self.big = big
        norms = np.array([self._length(sum(v * v for v in c)) for c in centroids])
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    @staticmethod
    def _length(square: int) -> float:
        try:
            return math.sqrt(square)
        except OverflowError:
            return math.inf

    def distances(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = x - self.c[to]
        return (d * d).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, and how many comparisons that took."""
        if self.big and x.dtype != object:
            x = x.astype(object)
        if x.dtype == object:
            lengths = np.array([self._length(int(v)) for v in (x * x).sum(1)])
        else:
            lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        k = len(self.norms)
        at = np.clip(np.searchsorted(self.norms, lengths), 0, k - 1)
        below = np.maximum(at - 1, 0)
        with np.errstate(invalid="ignore"):
            at = np.where(np.abs(self.norms[below] - lengths) < np.abs(self.norms[at] - lengths), below, at)
        best = self.order[at]
        least = self.distances(x, best)
        bound = np.array([self._length(int(v)) for v in least]) if least.dtype == object else np.sqrt(least.astype(np.float64))
        # wider than all rounding of the three roots; where a root is beyond a double every centroid is compared
        with np.errstate(invalid="ignore"):
            slack = bound + 1e-9 * (lengths + bound + 1)
            low, high = lengths - slack, lengths + slack
        low, high = np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)
        first, last = np.searchsorted(self.norms, low, "left"), np.searchsorted(self.norms, high, "right")
        compared = len(x)
        for place in range(k):
            rows = np.flatnonzero((first <= place) & (place < last) & (at != place))
            if not len(rows):
                continue
            number = int(self.order[place])
            d = self.distances(x[rows], np.full(len(rows), number))
            compared += len(rows)
            nearer = (d < least[rows]) | ((d == least[rows]) & (number < best[rows]))
            rows = rows[nearer]
            best[rows], least[rows] = number, d[nearer]
        return best, least, compared


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    values = np.asarray(batch.column(batch.schema.get_field_index("e")).flatten(), np.float64)
    return values.reshape(-1, dim)


def _parts(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integers): vectors with small components together, the others by themselves."""
    small = np.abs(x).max(1, initial=0) * SCALE < small_below(x.shape[1])
    for rows in (np.flatnonzero(small), np.flatnonzero(~small)):
        if len(rows):
            yield rows, scaled(x[rows])


def _sums(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int) -> Iterator[pa.RecordBatch]:
    """A task's (cluster, component, limb, total) over its vectors; component -1 counts them."""
    search = Annulus(centroids)
    totals: dict[tuple[int, int], int] = {}
    for batch in batches:
        for _, ints in _parts(_matrix(batch, dim)):
            cluster, _, _ = search.nearest(ints)
            for c in np.unique(cluster):
                mine = ints[cluster == c]
                for d, v in [*enumerate(mine.sum(0)), (-1, len(mine))]:
                    totals[int(c), d] = totals.get((int(c), d), 0) + int(v)
    rows = [(c, d, place, v) for (c, d), total in totals.items() for place, v in enumerate(limbs_of(total))]
    columns = list(zip(*rows)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "component", "place", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int) -> Iterator[pa.RecordBatch]:
    search = Annulus(centroids)
    for batch in batches:
        x = _matrix(batch, dim)
        cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
        for rows, ints in _parts(x):
            cluster[rows], distance[rows], _ = search.nearest(ints)
        columns = [batch.column(batch.schema.get_field_index("vec_id")), pa.array(cluster), pa.array([int(v) if v <= LONG_MAX else None for v in distance], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])


def usable(df: DataFrame, vec_id: str, embedding: str, dim: int) -> DataFrame:
    """(vec_id, e): the rows that count, as doubles."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    finite = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.select(F.col(f"`{vec_id}`").alias("vec_id"), e.alias("e")).filter((F.size("e") == dim) & finite)


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """Of the k vectors with the least hashes of their ids; k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(key.alias("h"), "vec_id", "e").orderBy("h", "vec_id", "e").limit(k).collect()
    return [[int(v) for v in scaled(np.array([r.e], np.float64))[0]] for r in rows]


def next_centroids(vectors: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Each cluster's componentwise floor(sum / count); a cluster without vectors keeps its centroid."""
    sums = vectors.select("e").mapInArrow(lambda b: _sums(b, centroids, dim), "cluster int, component int, place int, total long")
    limbs: dict[tuple[int, int], dict[int, int]] = {}
    for r in sums.groupBy("cluster", "component", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        limbs.setdefault((r.cluster, r.component), {})[r.place] = int(r.total)
    values = {key: value_of(v) for key, v in limbs.items()}
    return [[values.get((c, d), 0) // values[c, -1] for d in range(dim)] if (c, -1) in values else old for c, old in enumerate(centroids)]


def cluster(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = SALT
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every usable row, the final centroids)."""
    spark = df.sparkSession
    vectors, path = written(usable(df, vec_id, embedding, dim), "vectors-kmeans")
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long"), centroids
    for _ in range(rounds):
        after = next_centroids(vectors, centroids, dim)
        if after == centroids:  # what does not move any more stays for all rounds to come
            break
        centroids = after
    kind = dict(vectors.dtypes)["vec_id"]
    out, _ = written(vectors.mapInArrow(lambda b: _assigned(b, centroids, dim), f"vec_id {kind}, cluster int, distance long"), "kmeans")
    remove(spark, path)
    return out, centroids


def digest_of(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows with their cluster's and the overall inertia and the digest of their centroid.

    The inertias are k numbers: added up by Spark, they join by broadcast.  A sum that no long holds is null.
    """
    added = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.max(F.col("distance").isNull()).alias("unknown")).collect()
    of = {r.cluster: None if r.unknown else int(r.s) for r in added}
    fits = lambda v: v if v is not None and v <= LONG_MAX else None
    total = fits(None if None in of.values() else sum(of.values()))
    k_rows = [(c, fits(v), total, digest_of(centroids[c])) for c, v in sorted(of.items())]
    known = assigned.sparkSession.createDataFrame(k_rows, "k_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(known), F.col("cluster") == F.col("k_cluster"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(assigned, centroids)


def sql() -> str:
    """The same rounds, every vector against every centroid, for values whose squares fit into a long."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.m[i]) * (v.e[i] - c.m[i])))::BIGINT"
    steps = [
        f"""k AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND list_count(embedding) = {DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, e) AS r, vec_id, e FROM k),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, vec_id, e) - 1)::INTEGER AS n, e AS m
  FROM (SELECT *, sha256('{SALT}' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h FROM v) ORDER BY h, vec_id, e LIMIT {CLUSTERS})"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min_by(n, (d, n)) AS n, min(d) AS d FROM (SELECT r, n, {distance} AS d FROM v, c{i} AS c) GROUP BY r)")
        if i < ROUNDS:
            steps.append(
                f"""u{i} AS (SELECT a.n, p.i, (sum(v.e[p.i]) // count(*) - CASE WHEN sum(v.e[p.i]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS x FROM a{i} a JOIN v USING (r), range(1, {DIM + 1}) p(i) GROUP BY a.n, p.i),
c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(u.m, c.m) AS m FROM c{i} c LEFT JOIN (SELECT n, list(x ORDER BY i) AS m FROM u{i} GROUP BY n) u USING (n))"""
            )
    return f"""
WITH {', '.join(steps)}
SELECT v.vec_id, a.n AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.n))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c USING (n)
"""
