"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: a vector's coordinates are cut
into four blocks, each block has a codebook of random unit vectors, and every choice of
one word a block is a direction.  A vector's score for a direction is the sum of four
block scores, so all directions above a bound are list-decoded from sorted half sums
without looking at the others, and its best direction is the best word of each block.
The codebooks grow with the largest label, so that there is a direction for about every
``PER_DIRECTION`` of its vectors, whatever their number: comparing so many costs about as
much as one more row.

A vector is stored under its best direction and looks into all directions that score
within a margin of its own best.  For two unit vectors at cosine t, the second one's
score for the first one's best falls short of its own best by about
sqrt(1 - t^2) * sqrt(2 / dimension) in standard deviation, and the margin is ``SIGMAS``
of these (0.12 at 0.98 and 64).  Of 400,000 random pairs at the threshold itself, at 16, 64
and 256 dimensions and 3 to 16 words a block, none fell short by more than 3.23.  Vectors that meet under a direction are compared in double
precision, and only pairs at the threshold or above are links.  Vectors travel once a
direction that somebody is stored under; which those are is found on numbers alone.

Equal vectors are one class throughout, so copies never meet.  Directions with more than
``BLOCK`` vectors are dealt into blocks of about that size by hash, on either side; a
block gives one row a vector (its number of links and a spanning link), never its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
or whose label is null, link with nothing; vectors of different length never link; a
null id is no component's id, and its row keeps nothing; equal ids are rows of their own;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, written
from .components import connected_components

BATCH = 1024  # vectors list-decoded at a time
BLOCKS, SIGMAS, PER_DIRECTION, THRESHOLD, BLOCK, SEED = 4, 3.5, 100, 0.98, 2048, 20


def codebooks(dim: int, words: int, seed: int = SEED) -> list[np.ndarray]:
    """A (words, width) array of unit vectors for each block; widths differ by one at most."""
    rng = np.random.default_rng([seed, dim, words])
    books = []
    for part in np.array_split(np.arange(dim), min(BLOCKS, dim)):
        c = rng.normal(size=(words, len(part)))
        books.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return books


def block_scores(x: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [], 0
    for c in books:
        out.append(x[:, at : at + c.shape[1]] @ c.T / np.sqrt(len(books)))
        at += c.shape[1]
    return out


def halves(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the first two and over the other blocks, for all choices of words."""
    n = len(scores[0])
    zero = np.zeros((n, 1))
    s = scores + [zero] * (BLOCKS - len(scores))
    return (s[0][:, :, None] + s[1][:, None, :]).reshape(n, -1), (s[2][:, :, None] + s[3][:, None, :]).reshape(n, -1)


def list_decode(first: np.ndarray, second: np.ndarray, bound: float) -> np.ndarray:
    """Of one vector's half sums, all directions (first * len(second) + second) that score at least the bound."""
    order = np.argsort(second)
    start = np.searchsorted(second[order], bound - first, side="left")
    counts = len(second) - start
    a = np.repeat(np.arange(len(first)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return a * len(second) + order[np.repeat(start, counts) + within]


def margin_for(dim: int, threshold: float = THRESHOLD, sigmas: float = SIGMAS) -> float:
    return sigmas * np.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(2 / dim)


def filters(x: np.ndarray, words: int, margin: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each unit vector its best direction and all within the margin of it."""
    first, second = halves(block_scores(x, codebooks(x.shape[1], words)))
    for a, b in zip(first, second):
        i, j = int(a.argmax()), int(b.argmax())
        yield i * len(b) + j, list_decode(a, b, a[i] + b[j] - margin)


def words_for(n: int) -> int:
    """Codebook size for n vectors: about a direction for every PER_DIRECTION of them."""
    return max(2, int(np.ceil((max(n, 1) / PER_DIRECTION) ** (1 / BLOCKS))))


def usable(embedding: Column, label: Column) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & embedding.isNotNull() & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def classes_of(df: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes of equal vectors in a label: cid, label, embedding, n, least id)."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), e.alias("e"))
    rows = rows.withColumn("cid", F.when(usable(F.col("e"), F.col("label")), F.xxhash64("label", "e")))
    classes = rows.filter("cid is not null").groupBy("cid").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "cid"), classes


def _assign(batches: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (cid, vector): the vector's bytes, its best direction, and those it looks into, its own among them."""
    for whole in batches:
        for first in range(0, whole.num_rows, BATCH):
            batch = whole.slice(first, BATCH)
            flat, offsets = batch.column(1).flatten(), np.concatenate([[0], np.cumsum(np.asarray(batch.column(1).value_lengths()))])
            values, dims = np.asarray(flat, np.float64), np.diff(offsets)
            n = batch.num_rows
            homes, looks, blobs = np.zeros(n, np.int64), [b""] * n, [b""] * n
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.stack([values[offsets[k] : offsets[k + 1]] for k in rows])
                # scaled by the largest component first, so that no square overflows
                unit = x / np.abs(x).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for k, v, (best, found) in zip(rows, x, filters(unit, words, margin_for(int(dim), threshold))):
                    homes[k], looks[k], blobs[k] = best, found, v.tobytes()
            counts = np.array([len(f) for f in looks])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(looks).astype(np.int64) if n else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(homes), lists], ["cid", "v", "home", "looks"])


def _links(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, many: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """Rows (class, links, root) for the looking vectors x among the stored ones y: how many rows each links with, and spanning links."""
    scale = lambda m: m / np.abs(m).max(1, keepdims=True)
    x, y = scale(x), scale(y)
    link = x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]) >= threshold
    link &= a[:, None] != b[None]
    hit = np.flatnonzero(link.any(1))
    if not len(hit):
        return []
    link, a = link[hit], a[hit]
    counts = link @ many
    root = np.full(len(a), -1, np.int64)
    seen = np.zeros(len(a), bool)
    extra: list[tuple[int, int, int]] = []
    for k in range(len(a)):  # components of this block
        if seen[k]:
            continue
        left = np.array([k])
        inside = np.zeros(len(a), bool)
        inside[k] = True
        reached = np.zeros(len(b), bool)
        while len(left):
            right = np.flatnonzero(link[left].any(0) & ~reached)
            reached[right] = True
            left = np.flatnonzero(link[:, right].any(1) & ~inside) if len(right) else right
            inside[left] = True
        least = b[reached].min()
        root[inside], seen = least, seen | inside
        extra += [(int(c), 0, int(least)) for c in b[reached] if c != least]
    return [*zip(a.tolist(), counts.tolist(), root.tolist()), *extra]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (label, dim, direction, stored block, looking block, role, class, rows, vector) in order, stored ones (role 0) first.

    The stored ones of a block are held, at most about BLOCK; those that look pass by in batches.
    """
    current, held, y, b, many = None, [], None, None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
        role, cid, n = (np.asarray(batch.column(k)) for k in (5, 6, 7))
        vectors = batch.column(8).to_pylist()
        out: list[tuple[int, int, int]] = []
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and keys[end] == keys[at] and role[end] == role[at]:
                end += 1
            if keys[at] != current:
                current, held, y = keys[at], [], None
            part = np.frombuffer(b"".join(vectors[at:end]), np.float64).reshape(end - at, -1)
            if role[at] == 0:
                held.append((part, cid[at:end], n[at:end]))
            elif held:
                if y is None:
                    y, b, many = (np.concatenate([h[k] for h in held]) for k in range(3))
                if len(y) > 1 or end - at > 1 or cid[at] != b[0]:
                    out += _links(part, y, cid[at:end], b, many, threshold)
            at = end
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cid", "links", "root"])


def _met(assigned: DataFrame, block: int) -> DataFrame:
    """(cid, grp, sb, lb, role) on numbers alone: whom each vector meets, in directions that somebody is stored under."""
    keys = ["label", "dim", "grp"]
    many = lambda c: F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias(c)
    stored = assigned.select("cid", "label", "dim", F.col("home").alias("grp"))
    looking = assigned.select("cid", "label", "dim", F.explode("looks").alias("grp"))
    sizes = stored.groupBy(*keys).agg(many("n_stored")).join(looking.groupBy(*keys).agg(many("n_looking")), keys)
    sizes = sizes.select(*[F.col(k).alias(f"z_{k}") for k in keys], "n_stored", "n_looking")
    on = [F.col(k) == F.col(f"z_{k}") for k in keys]
    part = lambda n: F.pmod(F.xxhash64("cid", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    s = stored.join(sizes, on).withColumn("sb", part("n_stored")).withColumn("lb", every("n_looking")).withColumn("role", F.lit(0))
    q = looking.join(sizes, on).withColumn("lb", part("n_looking")).withColumn("sb", every("n_stored")).withColumn("role", F.lit(1))
    names = ["cid", "grp", "sb", "lb", "role"]
    return s.select(*names).unionByName(q.select(*names))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of df."""
    spark = df.sparkSession
    rows, classes = classes_of(df, vec_id, embedding, label)
    classes, p0 = written(classes, "vectors")
    words = words_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    found = classes.select("cid", "e").mapInArrow(lambda b: _assign(b, words, threshold), "a_cid long, v binary, home long, looks array<long>")
    numbers = classes.select("cid", "label", "n", "least", F.size("e").alias("dim"))
    assigned, p1 = written(numbers.join(found, F.col("cid") == F.col("a_cid")).drop("a_cid"), "vector-filters")
    met = _met(assigned, block).withColumnRenamed("cid", "m_cid")
    vectors = assigned.select("cid", "label", "dim", "n", "v")
    dealt = met.join(vectors, F.col("m_cid") == F.col("cid")).select("label", "dim", "grp", "sb", "lb", "role", "cid", "n", "v")
    places = ["label", "dim", "grp", "sb", "lb"]
    links = dealt.repartition(*places).sortWithinPartitions(*places, "role").mapInArrow(lambda b: _compare(b, threshold), "cid long, links long, root long")
    links, p2 = written(links, "vector-links")
    remove(spark, p0)
    counts = links.groupBy("cid").agg(F.sum("links").alias("links")).select(F.col("cid").alias("l_cid"), "links")
    parts = connected_components(links, "cid", "root")
    ids = assigned.select(F.col("cid").alias("i_cid"), "least", "n")
    of = parts.join(ids, F.col("node") == F.col("i_cid")).select("node", "component", "least")
    least_of = of.groupBy("component").agg(F.min("least").alias("least_id")).select(F.col("component").alias("p"), "least_id")
    of = of.join(least_of, F.col("component") == F.col("p")).select(F.col("node").alias("c_node"), "least_id")
    per_class = ids.join(counts, F.col("i_cid") == F.col("l_cid"), "left").join(of, F.col("i_cid") == F.col("c_node"), "left")
    per_class = per_class.select("i_cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least_id", "least").alias("least_id"))
    per_class, _ = written(per_class, "vector-classes")
    remove(spark, p1, p2)
    out = rows.join(per_class, F.col("cid") == F.col("i_cid"), "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("least_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
         AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
