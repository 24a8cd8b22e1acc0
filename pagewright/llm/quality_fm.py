"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), so all
pairwise interactions cost one pass over a document's features.  Features are word
buckets (counts scaled to unit length), statistics of the text's structure, and the
logarithms of any numeric metadata columns named (``n_chars`` in the query and the
stage); the latter two are standardised on the fitted rows.

Fitting takes at most ``sample`` labelled rows of each class (those with the smallest
hash of their id), whose features are computed where the texts are and gathered on the
driver; it is numpy with Adam and a fixed seed, so reruns agree.  Scoring covers every
row and whole texts.

Defined cases: null and empty texts are scored by their statistics; null and non-finite
metadata count as the fitted mean; null labels and ids are not learned from; of rows with
one labelled id the one with the least hash is learned from; an id with both labels counts
for both; with no labelled rows every score is 0.5; equal texts (and metadata) get equal
scores; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, sole_memory, trimmed

BUCKETS, FACTORS = 1 << 14, 8
SAMPLE = 3000  # labelled rows of each class, at most
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-4
LEAST_STEPS = 500
SIDE_BY_SIDE = 1 << 16  # features scored at a time
STATS = (
    "log_words", "log_bytes", "word_length", "upper", "digit", "symbol", "strong", "pipe", "period", "distinct",
    "repeats", "lines", "repeated_lines", "top_word", "long_words",
)

_classes = np.zeros((256, 6))
_classes[ord("A") : ord("Z") + 1, 0] = 1
_classes[ord("0") : ord("9") + 1, 1] = 1
_classes[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-"], 2] = 1
_classes[[ord(c) for c in "!?#$%&*"], 3] = 1
_classes[ord("|"), 4] = 1
_classes[ord("."), 5] = 1


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, and statistics of one whole text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    stats = np.zeros(len(STATS))
    stats[:2] = np.log1p(n), np.log1p(size)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), stats
    h = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    ids, counts = np.unique(h, return_counts=True)
    lines = [x for x in raw.split(b"\n") if x]
    of_bytes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _classes / size
    stats[2:] = [
        size / n, *of_bytes, len(ids) / n, np.count_nonzero(h[1:] == h[:-1]) / n, len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)), counts.max() / n, np.count_nonzero(counts == 1) / n,
    ]
    buckets, where = np.unique(ids % BUCKETS, return_inverse=True)
    values = np.bincount(where, counts).astype(np.float32)
    return buckets.astype(np.int32), values / np.sqrt((values**2).sum()), stats


@dataclass
class Model:
    bias: float
    w: np.ndarray  # buckets, then statistics and metadata
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def dense(self, stats: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(stats), self.mean, stats) - self.mean) / self.scale
        return np.clip(z, -4, 4)

    def scores(self, rows: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of rows as ``features`` gives them, all in one pass over their features."""
        if not len(rows):
            return np.zeros(0)
        n_dense = len(self.mean)
        tail = np.arange(BUCKETS, BUCKETS + n_dense)
        dense = self.dense(np.array([r[2] for r in rows], float))
        at = np.concatenate([part for r in rows for part in (r[0], tail)])
        x = np.concatenate([part for r, d in zip(rows, dense) for part in (r[1], d)])
        starts = np.cumsum([0, *[len(r[0]) + n_dense for r in rows[:-1]]])
        vx = self.v[at] * x[:, None]
        s = np.add.reduceat(vx, starts)
        y = self.bias + np.add.reduceat(self.w[at] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))

    def score(self, buckets: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        return float(self.scores([(buckets, values, stats)])[0])


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, n_dense: int = len(STATS)) -> Model:
    """Logistic loss, both classes weighing alike, on rows as ``features`` gives them; few rows are gone over more often."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + n_dense
    model = Model(0.0, np.zeros(width), rng.normal(0, 0.02, (width, FACTORS)), np.zeros(n_dense), np.ones(n_dense))
    if not len(rows):
        model.v[:] = 0
        return model
    stats = np.array([r[2] for r in rows], float)
    with np.errstate(invalid="ignore"):
        model.mean = np.nan_to_num(np.nanmean(np.where(np.isnan(stats), np.nan, stats), 0)) if stats.size else model.mean
    model.scale = np.where((s := np.nanstd(stats, 0)) > 1e-9, s, 1.0)
    dense = model.dense(stats)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    params = [np.zeros(1), model.w, model.v]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * min(BATCH, len(rows)) // len(rows)))):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), BATCH):
            pick = order[first : first + BATCH]
            sizes = [len(rows[k][0]) + n_dense for k in pick]
            at = np.concatenate([np.concatenate([rows[k][0], np.arange(BUCKETS, width)]) for k in pick])
            x = np.concatenate([np.concatenate([rows[k][1], dense[k]]) for k in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            row = np.repeat(np.arange(len(pick)), sizes)
            vx = model.v[at] * x[:, None]
            s = np.add.reduceat(vx, starts)
            y = params[0][0] + np.add.reduceat(model.w[at] * x, starts) + 0.5 * (s * s - np.add.reduceat(vx * vx, starts)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            gx = g[row] * x
            used, inverse = np.unique(at, return_inverse=True)
            gv = gx[:, None] * (s[row] - vx)
            grads = [np.array([g.sum()]), np.bincount(inverse, gx), np.stack([np.bincount(inverse, gv[:, f]) for f in range(FACTORS)], 1)]
            step += 1
            for k, (p, grad, (m1, m2)) in enumerate(zip(params, grads, moments)):
                i = slice(None) if k == 0 else used
                grad = grad + DECAY * p[i] * (k > 0)
                m1[i] = 0.9 * m1[i] + 0.1 * grad
                m2[i] = 0.99 * m2[i] + 0.01 * grad**2
                p[i] -= RATE * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)
    model.bias = float(params[0][0])
    return model


def _inputs(df: DataFrame, text: str, metadata: Sequence[str], *first: Column) -> DataFrame:
    values = [F.col(f"`{m}`").cast("double") for m in metadata]
    logs = [F.when(F.abs(v) < float("inf"), F.signum(v) * F.log1p(F.abs(v))) for v in values]
    return df.select(*first, F.col(f"`{text}`").alias("t"), F.array(*logs).cast("array<double>").alias("meta"))


def _of(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for text, meta in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()):
        b, x, s = features(text)
        yield b, x, np.concatenate([s, np.array([np.nan if m is None else m for m in meta], float)]) if meta else s


def sample_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, metadata: Sequence[str], sample: int) -> tuple[list, np.ndarray]:
    """Features and labels of the bounded sample, on the driver."""
    chosen = None
    marks = labels.select(F.col(f"`{doc_id}`").alias("s_id"), F.col(f"`{label}`").alias("y"))
    for value in (0, 1):
        of_class = marks.filter(F.col("y") == value).groupBy("s_id").agg(F.max("y").cast("int").alias("y"))
        top = of_class.orderBy(F.xxhash64("s_id"), "s_id").limit(sample)
        chosen = top if chosen is None else chosen.unionByName(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("quality", lambda: None)
        for batch in batches:
            got = list(_of(batch, 2))
            columns = [pa.array([r[k].astype(t).tobytes() for r in got], pa.binary()) for k, t in ((0, "<i4"), (1, "<f4"), (2, "<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["k", "y", "b", "x", "s"])

    # the broadcast side has 2 * sample rows of two numbers; of a hot id one row is left before the shuffle
    joined = _inputs(docs, text, metadata, F.col(f"`{doc_id}`").alias("d_id")).join(F.broadcast(chosen), F.col("d_id") == F.col("s_id"))
    one = joined.groupBy(F.col("d_id").cast("string").alias("k"), "y").agg(F.min(F.struct(F.xxhash64("t", "meta").alias("h"), "t", "meta")).alias("r"))
    rows = one.select("k", "y", "r.t", "r.meta").mapInArrow(trimmed(run), "k string, y int, b binary, x binary, s binary").collect()
    rows.sort(key=lambda r: (r.k, r.y))
    return [(np.frombuffer(r.b, "<i4"), np.frombuffer(r.x, "<f4"), np.frombuffer(r.s, "<f8")) for r in rows], np.array([r.y for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", metadata: Sequence[str] = (), sample: int = SAMPLE) -> Model:
    rows, marks = sample_rows(docs, labels.filter(F.col(f"`{doc_id}`").isNotNull()), doc_id, text, label, metadata, sample)
    return fit(rows, marks, n_dense=len(STATS) + len(metadata))


def score(docs: DataFrame, model: Model, text: str = "text", metadata: Sequence[str] = (), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with its score."""
    kinds = dict(docs.dtypes)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_memory("quality", lambda: None)
        for batch in batches:
            scores, held, size = [], [], 0
            for f in _of(batch, n):
                held.append(f)
                size += len(f[0])
                if size >= SIDE_BY_SIDE:
                    scores.append(model.scores(held))
                    held, size = [], 0
            scores.append(model.scores(held))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n)], pa.array(np.concatenate(scores), pa.float64())], [f"c{k}" for k in range(n + 1)])

    schema = ", ".join([*[f"c{k} {kinds[c]}" for k, c in enumerate(keep)], f"c{n} double"])
    rows = _inputs(docs, text, metadata, *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    return rows.mapInArrow(trimmed(run), schema).toDF(*keep, "score")


METADATA = ("n_chars",)


def learned_rows(labels: DataFrame) -> DataFrame:
    return labels.filter(crc_fold(F.col("doc_id"), 5) != 0)


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, learned_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")), metadata=METADATA)
    return score(docs, model, metadata=METADATA).select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Filtering stage: the rows of docs that score at least the threshold."""
    metadata = [c for c in METADATA if c in docs.columns]
    model = train(docs, learned_rows(labels), metadata=metadata)
    number = {c: f"k{k}" for k, c in enumerate(docs.columns)}
    out = score(docs.toDF(*number.values()), model, number["text"], [number[c] for c in metadata], list(number.values()))
    return out.filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
